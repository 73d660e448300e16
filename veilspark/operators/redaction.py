"""Redaction of text columns, in the order of the detectors.

One projection for each detector: nested expressions of all detectors would be resolved too slowly, and Catalyst
keeps projections apart whose result is used more than once. Each detector scans a text once; whether it fired is
seen from the text having changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.catalog import DIGIT_FREE, Detector
from veilspark.functions.columns import contains_any, has_digit, java, matches_of, named, screened, token
from veilspark.functions.policy import Policy, select

EMPTY = "CAST(array() AS array<string>)"


def redact_gated(text: Column, d: Detector) -> Column:
    """Struct (text, hit): matches near a keyword are replaced from right to left, so that what stands right of a
    match is looked at as already redacted."""
    pieces, found = F.split(text, java(d), -1), matches_of(text, d)
    last = F.element_at(pieces, -1)
    state = F.struct(last.alias("rest"), (F.length(text) - F.length(last)).alias("end"), F.lit(False).alias("hit"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["end"] - F.length(pair["found"])
        low = F.greatest(F.lit(0), start - d.window)
        near = F.lower(F.concat(text.substr(low + 1, acc["end"] - low), acc["rest"].substr(F.lit(1), F.lit(d.window))))
        hit = contains_any(near, d.keywords)
        put = F.when(hit, F.lit(token(d))).otherwise(pair["found"])
        return F.struct(F.concat(pair["piece"], put, acc["rest"]).alias("rest"), (start - F.length(pair["piece"])).alias("end"), (acc["hit"] | hit).alias("hit"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("found")))
    folded = F.aggregate(F.reverse(pairs), state, step, lambda acc: F.struct(acc["rest"].alias("text"), acc["hit"].alias("hit")))
    return F.when(contains_any(F.lower(text), d.keywords) & text.rlike(java(d)), folded).otherwise(F.struct(text.alias("text"), F.lit(False).alias("hit")))


def redact_columns(df: DataFrame, columns: dict[str, str], policy: Policy | None = None, gated: bool = True) -> DataFrame:
    """df with each text column of `columns` redacted, and a new column for each, of the name given: the detectors
    that fired, in order. Null stays null, without types."""
    policy = policy or select()
    if not columns or not policy.detectors:
        return df.withColumns({t: F.expr(EMPTY) for t in columns.values()}) if columns else df
    names = {c: (f"_{i}_new", f"_{i}_old", f"_{i}_types", f"_{i}_digit") for i, c in enumerate(columns)}
    whole = {c: F.col(named(c)).cast("string") for c in columns}
    df = df.withColumns({k: v for c, (new, old, types, digit) in names.items() for k, v in ((new, whole[c]), (old, whole[c]), (types, F.expr(EMPTY)), (digit, has_digit(whole[c])))})
    before: Detector | None = None

    def fired(new: str, old: str, types: str) -> Column:
        return F.when(F.col(new) != F.col(old), F.concat(types, F.array(F.lit(before.name)))).otherwise(F.col(types)) if before else F.col(types)

    for d in [*policy.plain, *(policy.gated if gated else ())]:
        step = {}
        for new, old, types, digit in names.values():
            text = F.col(new)
            changed = redact_gated(text, d)["text"] if d.keywords else F.regexp_replace(text, java(d), token(d))
            changed = changed if d.keywords else screened(text, d, changed, text)
            step |= {new: changed if d.name in DIGIT_FREE else F.when(F.col(digit), changed).otherwise(text), old: text, types: fired(new, old, types)}
        df = df.withColumns(step)
        before = d
    df = df.withColumns({types: fired(new, old, types) for new, old, types, _ in names.values()})
    df = df.withColumns({k: v for c, (new, _, types, _) in names.items() for k, v in ((c, F.col(new)), (columns[c], F.col(types)))})
    return df.drop(*[n for group in names.values() for n in group])


def _line_step(d: Detector) -> Callable[[Column], Column]:
    if d.keywords:
        return lambda line: redact_gated(line, d)["text"]
    return lambda line: screened(line, d, F.regexp_replace(line, java(d), token(d)), line)


def redact_lines(df: DataFrame, text: str, keys: list[str], policy: Policy | None = None) -> DataFrame:
    """Log texts, line by line: keys, text, lines_redacted, types (sorted); line ends stay. All inside the row, so that
    nothing is shuffled and keys may repeat: one projection over the array of lines for each detector."""
    policy = policy or select()
    ends = "(?<=\\n)|(?<=\\r)(?!\\n)|(?<=[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])"
    whole = F.col(named(text)).cast("string")
    df = df.select(*keys, F.split(whole, ends, -1).alias("_lines"), F.expr(EMPTY).alias("_types")).withColumns({"_new": F.col("_lines"), "_old": F.col("_lines")})
    before: Detector | None = None

    def fired() -> Column:
        return F.when(F.col("_new") != F.col("_old"), F.concat("_types", F.array(F.lit(before.name)))).otherwise(F.col("_types")) if before else F.col("_types")

    for d in [*policy.plain, *policy.gated]:
        df = df.withColumns({"_new": F.transform("_new", _line_step(d)), "_old": F.col("_new"), "_types": fired()})
        before = d
    df = df.withColumn("_types", fired())
    changed = F.size(F.filter(F.zip_with("_lines", "_new", lambda a, b: a != b), lambda x: x))
    return df.select(*keys, F.array_join("_new", "").alias("text"), F.coalesce(F.when(F.col("_lines").isNotNull(), changed), F.lit(0)).cast("long").alias("lines_redacted"), F.array_sort("_types").alias("types"))
