"""Secrets in texts: fixed patterns, and a linear-chain conditional random field.

Tokens are runs of ``[A-Za-z0-9+/_~.-]`` with up to two ``=`` behind, and runs of other visible characters.
The field tags every token as begin, inside or outside of a secret from its
shape, the words beside it and features of the whole file, and Viterbi finds
the best tags of the whole text.  The score of each token's shape is worked out
once for each word.  Where even the most that any words beside it and any tags
next to it could add leaves a token outside, it is outside in the best chain,
and only the runs between such tokens are scored in full and decoded: the
result is that of the whole chain.

The field is trained on invented lines that ``training_lines`` makes from a
seed; its weights have a fixed size and are broadcast.  Documents are handled
one by one: no shuffle, and memory is bounded by one document.  A null text is
empty; an empty text has no spans.  Offsets count code points, ends excluded.
"""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "learned")
#: Hashed features, training lines, rounds of training and the seed of both.
FEATURES, LINES, ROUNDS, SEED = 1 << 13, 2400, 150, 17
#: Words and characters of words whose scores a worker holds at most between texts.
MOST_WORDS, MOST_CHARS = 1 << 18, 1 << 24
#: Tokens of a text bounded at once.
BLOCK = 1 << 16

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = r"A-Za-z0-9+/_~.\-"
_TOKEN = re.compile(rf"[{_RUN}]+={{0,2}}|[^\s{_RUN}]+")
_WORDS = re.compile(r"[A-Za-z]+|[^\sA-Za-z]")
_SHORT = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")

# Words that often stand before a secret.
CUES = frozenset("secret token key apikey api password passwd pwd pass bearer authorization auth credential credentials private access client signature sig session jwt hook webhook".split())
#: Tags: outside, begin, inside.
OUT, BEGIN, INSIDE = range(3)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of what the fixed patterns find."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# -- tokens and features -----------------------------------------------------


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of every token."""
    return [m.span() for m in _TOKEN.finditer(text)]


@lru_cache(maxsize=1)
def _entropy(word: str) -> float:
    return math.log2(len(word)) - sum(n * math.log2(n) for n in map(word.count, set(word))) / len(word) if len(word) < 1000 else -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def shape_features(word: str) -> list[str]:
    """What a token looks like."""
    runs = _SHORT.findall(word)
    kinds = "".join("a" if r[0].islower() else "A" if r[0].isupper() else "9" if r[0].isdigit() else r[0] for r in runs)
    digits = sum(map(word.count, string.digits)) if word.isascii() else sum(c.isdigit() for c in word)
    letters = sum(len(r) for r in runs if r[0].isalpha()) if word.isascii() else sum(c.isalpha() for c in word)
    vowels = sum(map(word.count, "aeiouAEIOU"))
    return [
        f"len={min(len(word) // 4, 12)}",
        f"runs={min(len(runs), 12)}",
        f"perrun={min(len(word) // len(runs), 8)}",
        f"kinds={kinds[:6]}",
        f"head={word[:3]}",
        f"set={''.join(sorted(set(kinds)))}",
        f"entropy={round(_entropy(word) * 2)}",
        f"digits={digits * 5 // len(word)}",
        f"vowels={vowels * 5 // max(1, letters)}",
        f"dots={min(word.count('.'), 4)}",
        f"dashes={min(word.count('-'), 5)}",
        f"slashes={min(word.count('/'), 4)}",
        f"longest={min(max(map(len, runs)) // 3, 8)}",
        f"upper={word != word.lower()}",
    ]


def file_features(text: str) -> list[str]:
    """What the whole text is like."""
    size = max(1, len(text))
    code = sum(text.count(c) for c in "{}()[];=<>$")
    low = text.lower()
    cues = sum(low.count(c) for c in ("secret", "token", "password", "key"))
    return [f"code={min(5, code * 100 // size)}", f"cues={min(3, cues)}", f"lines={min(4, text.count(chr(10)) * 100 // size)}"]


_LETTER = frozenset(string.ascii_letters).__contains__


def _mark(word: str) -> str:
    """A neighbouring character that is no letter; those beyond ASCII are one."""
    return "" if word[0].isalpha() else word if word.isascii() else "other"


def token_features(text: str, start: int, end: int) -> list[str]:
    """Shape of a token and the words around it."""
    low = max(0, start - 60)
    while low and _LETTER(text[low]) and _LETTER(text[low - 1]):  # no word is cut
        low -= 1
    before = _WORDS.findall(text[low:start])
    after = _WORDS.findall(text[end : end + 20])
    out = shape_features(text[start:end])
    words = [w.lower() for w in before if w[0].isalpha()][-3:]
    for i, w in enumerate(reversed(words)):
        out.append(f"word-{i + 1}={w if w in CUES else 'other'}")
    out.append(f"cue={any(w in CUES for w in words)}")
    out.append(f"mark={_mark(before[-1]) if before else ''}")
    out.append(f"next={_mark(after[0]) if after else ''}")
    out.append(f"both={any(w in CUES for w in words)}/{round(_entropy(text[start:end]))}")
    return out


def _hashed(features: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(f.encode()) % FEATURES for f in features], dtype=np.int64)


# -- the field -----------------------------------------------------------------


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a run whose neighbours on both sides are outside."""
    best = scores[0] + moves[OUT]
    back = []
    for row in scores[1:]:
        total = best[:, None] + moves
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + row
    tag = int((best + moves[:, OUT]).argmax())
    tags = [tag]
    for step in reversed(back):
        tag = int(step[tag])
        tags.append(tag)
    return tags[::-1]


def _random(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))


def training_lines(seed: int = SEED, lines: int = LINES) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts and the spans of their secrets."""
    rng = random.Random(seed)
    both, mixed = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    low, up, hexa = string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"

    def word() -> str:
        return "".join(rng.choice(["an", "er", "the", "on", "ti", "st", "re", "in", "ou", "ble", "qu", "ei", "sch", "ción"]) for _ in range(rng.randint(1, 4)))

    def spoken() -> str:
        """A word as it stands in a sentence."""
        w, how = word(), rng.random()
        w = w.capitalize() if how < 0.15 else w.upper() if how < 0.2 else str(rng.randint(1, 9999)) if how < 0.26 else rng.choice("aAI&") if how < 0.3 else w
        return w + rng.choice(["", "", "", "", "", ".", ",", ".", ";", "..."])

    def words(n: int) -> str:
        return " ".join(spoken() for _ in range(n))

    def r(alphabet: str, a: int, b: int) -> str:
        return _random(rng, alphabet, a, b)

    secret = [
        lambda: r(mixed, 40, 40), lambda: "ghp_" + r(both, 36, 36), lambda: "sk_live_" + r(both, 24, 32), lambda: "AIza" + r(both + "_-", 35, 35), lambda: f"xoxb-{r(string.digits, 11, 12)}-{r(both, 24, 24)}",
        lambda: f"eyJ{r(both, 30, 60)}.eyJ{r(both, 40, 90)}.{r(both + '_-', 43, 43)}", lambda: r(both, 20, 64), lambda: r(mixed, 43, 64) + "==", lambda: "glpat-" + r(both + "-", 20, 20), lambda: r(low, 32, 40), lambda: "SG." + r(both, 22, 22) + "." + r(both, 43, 43),
    ]
    plain = [
        lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"mail{rng.randint(1, 99)}.example.com", lambda: f"{word()}.{rng.randint(1, 99)}",
        lambda: f"https://www.{word()}.org/{word()}/{rng.randint(1, 99999)}.html".replace(":", ""), lambda: f"https://www.{word()}.{rng.choice(['org', 'com'])}/{word()}/{word()}-{rng.randint(1, 9999)}{rng.choice(['', '.html'])}", lambda: f"/usr/lib/{word()}/{word()}{rng.randint(1, 9)}.so", lambda: f"{word()}-{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}.tar.gz",
        lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}", lambda: "-".join(r(hexa, n, n) for n in (8, 4, 4, 4, 12)), lambda: f"{word()}_{word()}_{rng.randint(1, 99)}", lambda: f"{word().capitalize()}{word().capitalize()}{rng.randint(1, 9)}",
        lambda: f"{r(up, 3, 4)}-{rng.randint(1000, 9999)}-{word()}", lambda: f"{word()}{rng.randint(1900, 2030)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-beta{rng.randint(1, 9)}", lambda: f"{rng.randint(10**15, 10**16)}{rng.choice(['', 'x', 'th'])}", lambda: f"{word()}.{word()}{rng.randint(1, 99)}.{word()}",
        lambda: f"{word()}...{word()}{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 99)}-{word()}-{word()}", lambda: f"{word()}/{word()}/{rng.randint(1, 9)}{word()}", lambda: f"0{rng.randint(0, 7)}/{rng.randint(10, 29)}/20{rng.randint(10, 30)}and{word()}",
    ]
    cue = ["Authorization: Bearer ", "access key ", "private_key=", "client credentials: ", "secret key is ", "auth ", "jwt: ", "webhook ", "signature=", "session ", "key: ", 'pwd = "', "credential ", "use the key "]
    name = ['pwd = "', "pass: ", "pwd=", "auth=", "client_key = '", "credential: ", "sig=", "webhook: ", "accessKey: ", "Authorization: Bearer ", 'session = "', "signature: ", "private key: ", "key = "]
    # of letters alone or short, where they are named
    short = [lambda: r(string.ascii_letters, 16, 32), lambda: r(string.ascii_lowercase, 18, 30), lambda: r(both, 8, 16), lambda: r(low, 9, 16), lambda: word() + r(string.digits, 4, 6), lambda: r(string.ascii_letters, 10, 15)]
    usual = "required optional undefined example default string number value values enabled disabled important located between settings Tuesday Chairman received function parameter document library another nothing".split()
    dull = [lambda: rng.choice(usual), lambda: word().capitalize() + word(), lambda: f"{word()}_{word()}", lambda: f"{word()}-{word()}", lambda: f"{word()}.{word()}", lambda: word() + word() + word(), lambda: f"{word()}/{word()}", lambda: f"{word()}{rng.randint(1, 9)}"]
    out = []
    for _ in range(lines):
        text, spans = words(rng.randint(0, 6)), []
        kind = rng.random()
        if kind > 0.68:
            text += " " + rng.choice(name)
            value = rng.choice(short)() if kind > 0.84 else rng.choice(dull)() + rng.choice(["", "", ".", ". " + word().capitalize(), " " + word()])
            if kind > 0.84:
                spans.append((len(text), len(text) + len(value)))
            text += value + rng.choice(["", "", '"', ","])
        elif kind < 0.28:
            text += " " + (rng.choice(cue) if rng.random() < 0.85 else "")
            value = rng.choice(secret)()
            spans.append((len(text), len(text) + len(value)))
            text += value
            if rng.random() < 0.1:  # a secret over two tokens
                more = r(mixed, 40, 64)
                spans.append((len(text) + 1, len(text) + 1 + len(more)))
                text += "\n" + more
            if rng.random() < 0.3:
                text += '"'
        else:
            text += " " + (rng.choice(cue) if rng.random() < 0.15 else "") + rng.choice(plain)()
            if rng.random() < 0.3:
                text += " " + rng.choice(plain)()
        out.append((text + " " + words(rng.randint(0, 5)), spans))
    return out


def _examples(lines: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[list[np.ndarray], list[int]]]:
    out = []
    for text, spans in lines:
        inside = file_features(text)
        chain, tags, last = tokens(text), [], OUT
        for start, end in chain:
            hit = any(start < b and a < end for a, b in spans)
            tags.append((INSIDE if last != OUT else BEGIN) if hit else OUT)
            last = tags[-1]
        out.append(([_hashed(token_features(text, a, b) + inside) for a, b in chain], tags))
    return out


def train(lines: list[tuple[str, list[tuple[int, int]]]] | None = None, rounds: int = ROUNDS, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the greatest penalised likelihood (Adam over all lines at once)."""
    examples = _examples(training_lines() if lines is None else lines)
    n, most = len(examples), max(len(t) for _, t in examples)
    width = max(len(f) for fs, _ in examples for f in fs)
    gold = np.zeros((n, most), dtype=np.int64)
    length = np.array([len(t) for _, t in examples])
    on = np.arange(most)[None, :] < length[:, None]
    feats = np.full((int(length.sum()), width), FEATURES, dtype=np.int64)  # of the tokens there are, line by line
    for i, (_, tags) in enumerate(examples):
        gold[i, : len(tags)] = tags
    for j, f in enumerate(f for fs, _ in examples for f in fs):
        feats[j, : len(f)] = f
    w, m = np.zeros((FEATURES + 1, 3)), np.zeros((3, 3))
    forbidden = np.zeros((3, 3))
    forbidden[OUT, INSIDE] = -1e4
    state = [np.zeros_like(x) for x in (w, w, m, m)]
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        w[FEATURES] = 0
        moves = m + forbidden
        score = np.zeros((n, most, 3))
        score[on] = sum(w[feats[:, k]] for k in range(width))
        alpha, beta = np.zeros((n, most, 3)), np.zeros((n, most, 3))
        alpha[:, 0] = score[:, 0] + moves[OUT]
        for j in range(1, most):
            alpha[:, j] = score[:, j] + np.logaddexp.reduce(alpha[:, j - 1, :, None] + moves, axis=1)
        beta[:] = moves[:, OUT]
        for j in range(most - 2, -1, -1):
            more = np.logaddexp.reduce(moves[None] + (score[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
            beta[:, j] = np.where((j + 1 < length)[:, None], more, moves[:, OUT])
        total = np.logaddexp.reduce(alpha[rows, length - 1] + moves[:, OUT], axis=1)
        chance = np.exp(alpha + beta - total[:, None, None])
        error = (chance - np.eye(3)[gold])[on]
        gw = np.stack([np.bincount(feats.ravel(), np.repeat(error[:, k], width), FEATURES + 1) for k in range(3)], axis=1) / n + decay * w
        gm = np.zeros((3, 3))
        gm[OUT] += chance[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=3)
        last = chance[rows, length - 1]
        gm[:, OUT] += last.sum(axis=0)
        np.add.at(gm, (gold[rows, length - 1], np.full(n, OUT)), -1)
        for j in range(1, most):
            use = j < length
            pair = np.exp(alpha[use, j - 1, :, None] + moves + (score[use, j] + beta[use, j])[:, None, :] - total[use, None, None])
            gm += pair.sum(axis=0)
            np.add.at(gm, (gold[use, j - 1], gold[use, j]), -1)
        gm = gm / n + decay * m
        for x, g, first, second in ((w, gw, state[0], state[1]), (m, gm, state[2], state[3])):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            x -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    w[FEATURES] = 0
    return w[:FEATURES], m + forbidden


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    """The field as trained on the default lines, once in a process."""
    return train()


def _gain(weights: np.ndarray, features: list[str]) -> np.ndarray:
    """What features add to begin and to inside, over outside."""
    rows = weights[_hashed(features)]
    return (rows[:, BEGIN:] - rows[:, OUT:BEGIN]).sum(axis=0)


class Bounds(dict):
    """Which tokens can be other than outside: by word, its row in ``rows``.

    Where best tags are not outside, they lose nothing up to the next token that
    is, or outside all the way would be better.  So a token is outside if for it
    and any number of tokens behind it the most they can gain is below nothing.
    Their scores are known but for words before a token, where the most that they
    can add counts, and long white space, where a neighbouring character counts or
    none.
    """

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves, self.gains = weights, moves, {}
        cues = [np.array([_gain(weights, [f"word-{i}={w}"]) for w in sorted(CUES)]) for i in (1, 2, 3)]
        other = [_gain(weights, [f"word-{i}=other"])[None] for i in (1, 2, 3)]
        self.words = []  # by whether a cue is among the words before: most begin, most inside
        for cue in (False, True):
            base, ends = _gain(weights, [f"cue={cue}"]), []
            for n in range(4):
                for cued in range(1 << n):
                    if bool(cued) == cue:
                        parts = [base[None], *(cues[i] if cued >> i & 1 else other[i] for i in range(n))]
                        ends.append(sum(x.max(axis=0) for x in parts))
            self.words.append(np.max(ends, axis=0)[:, None])
        self.none = [_gain(weights, [f"{side}="]) for side in ("mark", "next")]
        self.enter = (moves[:, BEGIN:].max(axis=0) - moves[OUT, OUT])[:, None]
        self.leave = moves[BEGIN:, OUT].max() - moves[:, OUT].min()
        self.rows, self.chars = array("d"), 0

    def gain(self, feature: str) -> tuple[float, float]:
        """What one feature adds, kept; there are few but for those of heads and kinds, of up to six characters."""
        if feature not in self.gains:
            if len(self.gains) > MOST_WORDS:
                self.gains.clear()
            self.gains[feature] = tuple(_gain(self.weights, [feature]).tolist())
        return self.gains[feature]

    def __missing__(self, word: str) -> int:
        begin = inside = 0.0
        for f in shape_features(word):
            g = self.gain(f)
            begin, inside = begin + g[0], inside + g[1]
        entropy, row = round(_entropy(word)), []
        for cue in (False, True):
            g = self.gain(f"both={cue}/{entropy}")
            row += [begin + g[0], inside + g[1]]
        row += [*self.gain(f"mark={_mark(word[-1])}"), *self.gain(f"next={_mark(word[0])}")]
        parts = [w for w in _WORDS.findall(word) if w[0].isalpha()]
        self.rows.extend([*row, len(parts), any(w.lower() in CUES for w in parts)])
        self[word] = len(self)
        self.chars += len(word)
        return len(self) - 1

    def open(self, text: str, whole: list[str]) -> np.ndarray:
        """Places of the tokens that can be other than outside, given the features of the text; a hair's breadth counts as open."""
        if len(self) > MOST_WORDS or self.chars > MOST_CHARS:
            self.clear()
            self.rows, self.chars = array("d"), 0
        at = np.fromiter((self[m[0]] for m in _TOKEN.finditer(text)), np.int64)
        if not len(at):
            return at
        table = np.frombuffer(self.rows).reshape(-1, 10)
        gain, beside = np.empty(len(at)), np.array([self.gain(f) for f in whole]).sum(axis=0)[:, None] + self.enter
        before, behind = (x[:, None] for x in self.none)
        spoken, cued = 0.0, -9.0  # words so far, and how many at the last token with a cue
        for low in range(0, len(at), BLOCK):
            high = low + BLOCK
            rows = table[at[low:high]].T
            most = rows[0:2] + self.words[0]
            so_far = spoken + np.cumsum(rows[8])
            last = np.maximum.accumulate(np.where(rows[9] > 0, so_far, cued))
            near = np.append(spoken, so_far[:-1]) - np.append(cued, last[:-1]) < 3
            if near.any():
                most[:, near] = np.maximum(most, rows[2:4] + self.words[1])[:, near]
            spoken, cued = so_far[-1], last[-1]
            marks = np.hstack([table[at[low - 1], 4:6][:, None] if low else before, rows[4:6, :-1]])
            nexts = np.hstack([rows[6:8, 1:], table[at[high], 6:8][:, None] if high < len(at) else behind])
            gain[low:high] = (most + np.maximum(marks, before) + np.maximum(nexts, behind) + beside).max(axis=0)
        total = np.append(0.0, np.cumsum(gain))
        best = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]  # of runs that begin at a token
        return np.flatnonzero(best + self.leave > -1e-6)


_bounds: list[Bounds] = []


def bounds(weights: np.ndarray, moves: np.ndarray) -> Bounds:
    """The bounds of a field; those of the last one are kept."""
    if not _bounds or _bounds[0].weights is not weights or _bounds[0].moves is not moves:
        _bounds[:] = [Bounds(weights, moves)]
    return _bounds[0]


def learned_spans(text: str, weights: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """Spans that the field tags, whole secrets over one or more tokens."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    inside = file_features(text)
    places = bounds(weights, moves).open(text, inside)
    if not len(places):
        return out
    wanted = set(places.tolist())
    spans = {i: m.span() for i, m in enumerate(_TOKEN.finditer(text)) if i in wanted}
    for chain in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
        scores = np.array([weights[_hashed(token_features(text, *spans[i]) + inside)].sum(axis=0) for i in chain])
        for i, tag in zip(chain, viterbi(scores, moves), strict=True):
            if tag == BEGIN:
                out.append(spans[i])
            elif tag == INSIDE and out:
                out[-1] = (out[-1][0], spans[i][1])
    return out


def spans_of(text: str, model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """All spans of a text as start, kind, end; a learned one only where no pattern matched."""
    base = base_spans(text)
    extra = [(a, 3, b) for a, b in learned_spans(text, *model) if not any(a < y and x < b for x, _, y in base)]
    return sorted(base + extra) if extra else base


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)
_ARROW_SPANS = pa.list_(pa.field("element", pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]), False))


def _mapped(df: DataFrame, text: str, make, schema: T.StructType) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trained())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield make(part, part.schema.get_field_index(text), shared.value)

    return df.mapInArrow(run, schema)


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds the spans of each text, by start and then kind, as structs of kind, start and end."""
    if out in df.columns:
        raise ValueError(f"column {out} exists already; name another")

    def make(part: pa.RecordBatch, at: int, model) -> pa.RecordBatch:
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(x or "", model)] for x in part.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, _ARROW_SPANS)], names=[*part.schema.names, out])

    return _mapped(df, text, make, T.StructType([*df.schema.fields, T.StructField(out, SPANS, False)]))


def redact(text: str | None, model: tuple[np.ndarray, np.ndarray], mark: str) -> str | None:
    """The text with each stretch that spans cover replaced; the name before an assigned value stays."""
    if not text:
        return text
    parts, at = [], 0
    for a, kind, b in spans_of(text, model):
        if kind == 0:
            a = _ASSIGN.match(text, a).start(2)
        if b <= at:
            continue
        parts += [text[at : max(a, at)], mark]
        at = b
    return "".join(parts) + text[at:] if at else text


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """The rows with secrets in their text replaced by a mark; null texts stay null."""

    def make(part: pa.RecordBatch, at: int, model) -> pa.RecordBatch:
        new = pa.array([redact(x, model, mark) for x in part.column(at).to_pylist()], pa.string())
        return part.set_column(at, part.schema.names[at], new)

    return _mapped(df, text, make, df.schema)
