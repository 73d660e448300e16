"""Selection of detectors and names: an immutable policy in place of module state."""

from __future__ import annotations

from dataclasses import dataclass, replace

from veilspark.functions import catalog
from veilspark.functions.catalog import Detector


@dataclass(frozen=True)
class Policy:
    """What is detected and which names are sensitive. Names are lower case."""

    detectors: tuple[Detector, ...]
    columns: frozenset[str]
    keys: frozenset[str]
    tables: frozenset[str]
    categories: frozenset[str]

    @property
    def plain(self) -> tuple[Detector, ...]:
        return tuple(d for d in self.detectors if not d.keywords)

    @property
    def gated(self) -> tuple[Detector, ...]:
        return tuple(d for d in self.detectors if d.keywords)

    def extended(self, columns: tuple[str, ...] = (), tables: tuple[str, ...] = ()) -> Policy:
        return replace(self, columns=self.columns | frozenset(columns), tables=self.tables | frozenset(tables))


def _names(groups: dict[str, tuple[str, ...]], wanted) -> frozenset[str]:  # noqa: ANN001
    return frozenset(n for group, names in groups.items() if wanted(group) for n in names)


def select(only: list[str] | None = None, skip: list[str] | None = None) -> Policy:
    """only: categories or detectors to keep; skip: those to leave out; never both. Unknown names are errors.

    Detectors of no category follow the names given, not the categories. Where both groups have a name, the later
    definition stands for it.
    """
    only, skip = list(only or ()), list(skip or ())
    if only and skip:
        raise ValueError("only and skip exclude each other")
    categories = {d.category for d in catalog.DETECTORS} - {"context"}
    names = {d.name for d in catalog.DETECTORS}
    if unknown := {*only, *skip} - categories - names:
        raise ValueError(f"unknown selectors: {', '.join(sorted(map(repr, unknown)))}")
    single = set(only) - categories
    if only:
        active = {c for c in categories if c in only} | {d.category for d in catalog.DETECTORS if d.name in single and d.category != "context"}
    else:
        active = categories - set(skip)

    def kept(d: Detector) -> bool:
        if d.name in skip:
            return False
        if d.category == "context":
            return not single or d.name in single
        return d.category in active and (not single or d.name in single or d.category in only)

    groups = lambda g: g in active or not only
    return Policy(tuple(d for d in catalog.DETECTORS if kept(d)), _names(catalog.SENSITIVE_COLUMNS, groups), _names(catalog.SENSITIVE_KEYS, groups), _names(catalog.PERSONAL_TABLES, groups), frozenset(active))


def listing() -> list[tuple[str, str, bool]]:
    """(category, detector, gated) of all detectors in order."""
    return [(d.category, d.name, bool(d.keywords)) for d in catalog.DETECTORS]
