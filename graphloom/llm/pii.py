"""Format-preserving pseudonyms for personal data, in built-in functions only.

Card numbers (Luhn), IBANs (mod 97), phone numbers, social security numbers,
IPv4 addresses, dates and e-mail addresses are found by pattern and validated.
Their digits, or the day a date stands for, go through a keyed Feistel network
over just the values of that format, walked in a cycle until the result is
valid again.  The network is a permutation: equal values get equal pseudonyms
in all documents, different values different ones, and check digits stay right.
Separators, length and layout stay as they were.  An e-mail address is the
exception: its local part becomes a keyed tag of 64 bits.

Rounds use SHA-256 of the key, so a pseudonym tells nothing without it.  One
row at a time: no shuffle and nothing collected.  Null texts stay null; an
empty text stays empty.  Other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a lap of a cycle walk and laps; each step fails with a chance of two
#: thirds at most, and a walk that has not ended then is an error.
WALK, LAPS = 64, 64

# The layouts of each kind.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[\p{L}0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/]|[.-][0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # not within an IBAN
    "card": "".join(f"(?<![A-Z]{{2}}[0-9]{{2}}{' [A-Z0-9]{4}' * n} )" for n in range(6)) + r"(?<![0-9])(?<![A-Z]{2})(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9A-Za-z.+-])(?<![0-9][ .-])[0-9]{3}([ .-])[0-9]{3,4}\1[0-9]{4}(?![ .-]?[0-9])",
}
#: A cheap test that any value of the above needs.
_HINT = r"[0-9@]"
# Days from 1900-01-01 to 2099-12-31.
_FIRST_DAY, _DAYS = -25567, 73049


@dataclass(frozen=True)
class Key:
    """Secret of the pseudonyms; the same key links values over runs."""

    secret: str


def _draw(key: Key, kind: str, round_: Column, half: Column, modulus: Column) -> Column:
    """Keyed number below ``modulus`` (at most 10 ** 15) for a round and half."""
    text = F.concat_ws("|", F.lit(key.secret), F.lit(kind), round_.cast("string"), half.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), modulus)


def feistel(value: Column, low: Column, high: Column, key: Key, kind: str) -> Column:
    """Keyed permutation of the numbers below low * high (each at most 10 ** 9).

    A value is taken as a pair (value // low, value % low); rounds add a keyed
    function of one part to the other in turn.
    """
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, F.pmod(s.a + _draw(key, kind, i, s.b, high), high)).otherwise(s.a)
        b = F.when(even, s.b).otherwise(F.pmod(s.b + _draw(key, kind, i, s.a, low), low))
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    begin = F.struct(F.floor(value / low).cast("long").alias("a"), F.pmod(value, low).cast("long").alias("b"))
    return F.aggregate(rounds, begin, step, lambda s: (s.a * low + s.b).cast("long"))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: Key, kind: str) -> Column:
    """Digit string of length 2 to 18 to another of the same length."""

    def with_length(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        low, high = _power(half), _power(n - half)
        # the two halves are kept apart: floor(value / low) would lose digits in doubles
        begin = F.struct(F.substr(d, F.lit(1), n - half).cast("long").alias("a"), F.substr(d, n - half + 1, half).cast("long").alias("b"))

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            a = F.when(even, F.pmod(s.a + _draw(key, kind, i, F.concat_ws(":", s.b, n), high), high)).otherwise(s.a)
            b = F.when(even, s.b).otherwise(F.pmod(s.b + _draw(key, kind, i, F.concat_ws(":", s.a, n), low), low))
            return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

        done = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(done, begin, step, lambda s: F.concat(F.lpad(s.a.cast("string"), n - half, "0"), F.lpad(s.b.cast("string"), half, "0")))

    return F.when(F.length(digits) >= 2, _let(digits, with_length)).otherwise(digits)


def _cycle(value: Column, step, valid) -> Column:
    """Steps from a valid value until one is valid again; a step is a permutation, so this is one too."""
    begin = F.struct(step(value).alias("v"), F.lit(False).alias("done"))

    def walk(s: Column, _: Column) -> Column:
        ok = F.coalesce(s.done | valid(s.v), F.lit(True))
        return F.struct(F.when(ok, s.v).otherwise(step(s.v)).alias("v"), ok.alias("done"))

    def lap(s: Column, _: Column) -> Column:
        return F.when(s.done, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), s, walk))

    unended = F.raise_error(F.lit(f"no valid pseudonym in {WALK * LAPS} steps"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LAPS)), begin, lap, lambda s: F.when(s.done, s.v).otherwise(unended))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit not doubled."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((n - 1 - i) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)


def _weave(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced by the given ones, in order."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s.text, F.when(digit, F.substr(digits, s.n + 1, F.lit(1))).otherwise(c)).alias("text"), (s.n + digit.cast("int")).alias("n"))

    return F.aggregate(F.split(layout, ""), start, step, lambda s: s.text)


def card(value: Column, key: Key) -> Column:
    """Luhn numbers to Luhn numbers; other digit runs of that length are permuted whole."""

    def new(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        check = luhn_sum(d) % 10

        def moved(b: Column) -> Column:
            # the last digit keeps the distance to the check digit: valid stays valid, invalid stays invalid
            total = luhn_sum(F.concat(b, F.lit("0")))
            return F.concat(b, F.pmod(check - total, F.lit(10)).cast("string"))

        return _let(permute_digits(body, key, "card"), moved)

    return _let(_digits(value), lambda d: _weave(value, new(d)))


def phone(value: Column, key: Key) -> Column:
    """The subscriber's digits; a country code stays."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(value, F.length(code) + 1)
    return _let(rest, lambda x: F.concat(code, _weave(x, permute_digits(_digits(x), key, "phone"))))


def ssn(value: Column, key: Key) -> Column:
    return _weave(value, _cycle(_digits(value), lambda d: permute_digits(d, key, "ssn"), _ssn_valid))


def _ssn_valid(digits: Column) -> Column:
    return digits.rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def ip(value: Column, key: Key) -> Column:
    """The address as a 32-bit number."""
    parts = F.split(value, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))

    def text(n: Column) -> Column:
        return F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))

    return F.when(F.forall(parts, lambda x: x.cast("int") <= 255), _let(feistel(number, F.lit(65536), F.lit(65536), key, "ip"), text)).otherwise(value)


def _moved_day(value: Column, layout: str, key: Key, valid=lambda v: F.lit(True)):
    def moved(d: Column) -> Column:
        n = F.datediff(d, F.lit("1970-01-01").cast("date")) - _FIRST_DAY
        walked = _cycle(n.cast("long"), lambda v: feistel(v, F.lit(256), F.lit(512), key, "date"), lambda v: (v >= 0) & (v < _DAYS) & valid(v))
        new = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), walked.cast("int")), layout)
        return F.when((n >= 0) & (n < _DAYS), new).otherwise(value)

    return moved


def date(value: Column, key: Key) -> Column:
    """The day between 1900 and 2099, in the same layout; other dates stay."""
    layouts = ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}/", "MM/dd/yyyy"), (r"^[0-9]{2}\.", "dd.MM.yyyy"))
    out = value
    for pattern, layout in layouts:
        day = F.try_to_date(value, layout)
        out = F.when(value.rlike(pattern) & day.isNotNull(), _let(day, _moved_day(value, layout, key))).otherwise(out)
    # day first, where the first number cannot be a month: to another such day
    other = F.try_to_date(value, "dd/MM/yyyy")
    late = _moved_day(value, "dd/MM/yyyy", key, lambda v: F.dayofmonth(F.date_add(F.lit("1900-01-01").cast("date"), v.cast("int"))) > 12)
    return F.when(value.rlike(r"^[0-9]{2}/") & F.try_to_date(value, "MM/dd/yyyy").isNull() & other.isNotNull(), _let(other, late)).otherwise(out)


def email(value: Column, key: Key) -> Column:
    """A local part of 17 letters, a keyed tag of the whole address, before the same domain."""
    tag = F.substring(F.sha2(F.concat_ws("|", F.lit(key.secret), F.lit("email"), F.lower(value)), 256), 1, 16)
    return F.concat(F.lit("u"), F.translate(tag, "0123456789", "ghijklmnop"), F.lit("@"), F.substring_index(value, "@", -1))


def iban(value: Column, key: Key) -> Column:
    """The account digits of a valid IBAN, with new check digits; others stay."""

    def number(x: Column) -> Column:
        compact = F.regexp_replace(x, " ", "")
        moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
        return F.aggregate(F.split(moved, ""), F.lit(0).cast("long"), _mod97)

    def new(x: Column) -> Column:
        body = F.substr(x, F.lit(5))
        digits = _digits(body)
        permuted = F.when(F.length(digits) <= 18, permute_digits(digits, key, "iban")).otherwise(
            F.concat(permute_digits(F.substring(digits, 1, 12), key, "iban1"), permute_digits(F.substr(digits, F.lit(13)), key, "iban2"))
        )

        def checked(b: Column) -> Column:
            bare = F.concat(F.substring(x, 1, 2), F.lit("00"), b)
            return F.concat(F.substring(x, 1, 2), F.lpad((98 - number(bare)).cast("string"), 2, "0"), b)

        return _let(_weave(body, permuted), checked)

    return F.when(number(value) == 1, new(value)).otherwise(value)


def _mod97(a: Column, c: Column) -> Column:
    code = F.when(c.rlike("[0-9]"), c.cast("long")).otherwise(F.ascii(c).cast("long") - 55)
    return F.when(code > 9, (a * 100 + code) % 97).otherwise((a * 10 + code) % 97)


_KINDS = {"email": email, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "card": card, "phone": phone}


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    if kind == "ssn":
        return _ssn_valid(_digits(value))
    if kind == "card":
        return luhn_sum(_digits(value)) % 10 == 0
    return F.lit(True)


def _replaced(text: Column, kind: str, key: Key) -> Column:
    """The text with every valid value of one kind replaced: what is between values, woven with pseudonyms."""
    found = F.regexp_extract_all(text, F.lit(f"({PATTERNS[kind]})".replace("\\2", "\\3").replace("\\1", "\\2")), F.lit(1))
    new = F.transform(found, lambda v: F.when(_valid(kind, v), _KINDS[kind](v, key)).otherwise(v))
    between = F.split(text, PATTERNS[kind])
    woven = _let(new, lambda n: F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(n, i), F.lit("")))), ""))
    return F.when(text.rlike(PATTERNS[kind]), woven).otherwise(text)


def pseudonymise(df: DataFrame, key: Key, text: str = "text", kinds: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """The rows with personal data in their text replaced by pseudonyms.

    A value that one kind replaced may be read by a later kind only if it has
    its layout too; the kinds' layouts are disjoint but for phone numbers,
    which come last.
    """
    out = df
    for kind in kinds:
        out = out.withColumn(text, F.when(F.col(text).rlike(_HINT), _replaced(F.col(text), kind, key)).otherwise(F.col(text)))
    return out
