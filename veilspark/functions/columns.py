"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.catalog import DIGIT_FREE, LITERALS, RUNS, Detector

#: Line ends of text files.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def java(d: Detector) -> str:
    """The detector's pattern with Unicode classes, as text columns need it."""
    return ("(?iU)" if d.ignore_case else "(?U)") + d.pattern


def token(d: Detector) -> str:
    return f"[REDACTED_{d.name.upper()}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w.lower()))
    return found


def named(column: str) -> str:
    """A column's name as an identifier."""
    if "\0" in column:
        raise ValueError("a name with a NUL")
    return "`" + column.replace("`", "``") + "`"


def may_match(text: Column, d: Detector) -> Column | None:
    """A test by plain strings, or a run of characters, without which the detector finds nothing; null where there is none."""
    if d.name in RUNS and not d.keywords:
        return text.rlike(RUNS[d.name])
    if d.keywords:
        return contains_any(F.lower(text), d.keywords)
    tests = [F.contains(text, F.lit(x)) for x in LITERALS.get(d.name, ())]
    return reduce(lambda a, b: a | b, tests) if tests else None


def screened(text: Column, d: Detector, value: Column, other: Column) -> Column:
    """value where the detector may find something in text, else other."""
    test = may_match(text, d)
    return value if test is None else F.when(test, value).otherwise(other)


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def matches_of(text: Column, d: Detector) -> Column:
    """All matches of a detector, without its gate."""
    return F.regexp_extract_all(text, F.lit(java(d)), 0)


def by_digit(text: Column, detectors: tuple[Detector, ...], make: Callable[[Detector], Column], nothing: Column) -> Column:
    """array(make(d), ...) for all detectors; nothing for those that need a digit or a string that text lacks."""
    free = [screened(text, d, make(d), nothing) for d in detectors if d.name in DIGIT_FREE]
    bound = [screened(text, d, make(d), nothing) for d in detectors if d.name not in DIGIT_FREE]
    parts = ([F.array(*free)] if free else []) + ([F.when(has_digit(text), F.array(*bound)).otherwise(F.array(nothing))] if bound else [])
    return F.concat(*parts) if parts else F.array(nothing)
