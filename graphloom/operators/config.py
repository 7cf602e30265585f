"""Configuration of graph walks and labels, and how targets inherit it."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from ..functions.terms import RDFS_LABEL


@dataclass(frozen=True)
class GraphConfig:
    """How nodes are walked and labelled.

    include_predicates: if any, only these are walked.  ignore_predicates: never
    walked.  predicate_limit: objects of each subject and predicate, chosen by
    stable score.  expansion_limit: depth of the walk beyond the root's edges.
    """

    label_predicates: tuple[str, ...] = ()
    ignore_predicates: tuple[str, ...] = ()
    include_predicates: tuple[str, ...] = ()
    predicate_limit: int | None = None
    expansion_limit: int = 1
    include_rdfs_label: bool = True

    def effective_label_predicates(self) -> tuple[str, ...]:
        extra = (RDFS_LABEL,) if self.include_rdfs_label and RDFS_LABEL not in self.label_predicates else ()
        return (*self.label_predicates, *extra)


@dataclass(frozen=True)
class LabelProfile:
    """Label template for the nodes of one type; fields map aliases to predicates."""

    type: str
    template: str
    fields: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TargetConfig(GraphConfig):
    """A type whose subjects become documents."""

    type: str = ""
    label_profile: str | None = None
    label_template: str | None = None
    label_fields: dict[str, str] = field(default_factory=dict)


_LISTS = ("label_predicates", "ignore_predicates", "include_predicates")
_SCALARS = ("predicate_limit", "expansion_limit", "include_rdfs_label")


def _checked(kind: type, values: dict[str, Any], where: str) -> dict[str, Any]:
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{where}: unknown settings {sorted(unknown)}")
    return {k: tuple(v) if k in _LISTS else v for k, v in values.items()}


@dataclass(frozen=True)
class Materialization:
    """Defaults, label profiles and targets.

    ``set_defaults`` and ``set_targets`` hold what was given explicitly: lists
    add up without repeats, scalars of a target win only if they were given.
    """

    set_defaults: dict[str, Any]
    label_profiles: dict[str, LabelProfile]
    set_targets: dict[str, dict[str, Any]]

    @staticmethod
    def from_dict(data: dict[str, Any]) -> Materialization:
        if unknown := set(data) - {"defaults", "label_profiles", "targets"}:
            raise ValueError(f"unknown sections {sorted(unknown)}")
        if "targets" not in data:
            raise ValueError("targets are missing")
        targets = {k: _checked(TargetConfig, v, f"targets.{k}") for k, v in data["targets"].items()}
        for name, target in targets.items():
            if not target.get("type"):
                raise ValueError(f"targets.{name}: type is missing")
        profiles = {k: LabelProfile(**_checked(LabelProfile, v, f"label_profiles.{k}")) for k, v in data.get("label_profiles", {}).items()}
        return Materialization(_checked(GraphConfig, data.get("defaults", {}), "defaults"), profiles, targets)

    @staticmethod
    def from_toml(path: str | Path) -> Materialization:
        with open(path, "rb") as f:
            return Materialization.from_dict(tomllib.load(f))

    @property
    def defaults(self) -> GraphConfig:
        return GraphConfig(**self.set_defaults)

    def target(self, name: str) -> TargetConfig:
        """The target with defaults merged in; an unknown name raises KeyError."""
        given = self.set_targets[name]
        merged = {k: tuple(dict.fromkeys([*self.set_defaults.get(k, ()), *given.get(k, ())])) for k in _LISTS}
        scalars = {k: v for part in (self.set_defaults, given) for k, v in part.items() if k in _SCALARS}
        own = {k: v for k, v in given.items() if k not in (*_LISTS, *_SCALARS)}
        return TargetConfig(**merged, **scalars, **own)

    def targets(self, name: str | None = None) -> list[tuple[str, TargetConfig]]:
        """One target by name, or all of them."""
        if name is not None and name not in self.set_targets:
            raise ValueError(f"unknown target: {name}")
        return [(n, self.target(n)) for n in ([name] if name is not None else self.set_targets)]

    def profile_for(self, type_iri: str) -> LabelProfile | None:
        return next((p for p in self.label_profiles.values() if p.type == type_iri), None)


def with_predicates(config: GraphConfig, **changes: Any) -> GraphConfig:
    """A copy of a configuration with other settings."""
    return replace(config, **changes)
