"""Detectors over text columns: matches as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.catalog import DIGIT_FREE, RUNS, Detector
from veilspark.functions.columns import LINE_ENDS, by_digit, contains_any, has_digit, java, matches_of, screened
from veilspark.functions.policy import Policy, select
from veilspark.functions.suppression import suppressed


def gated_matches(text: Column, d: Detector) -> Column:
    """Structs (match_text, start) of a gated detector's matches near one of its keywords; start in characters from 0."""
    pieces = F.split(text, java(d), -1)
    found = matches_of(text, d)
    empty = F.expr("CAST(array() AS array<struct<match_text:string,start:int>>)")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["found"])
        low = F.greatest(F.lit(0), start - d.window)
        near = F.lower(text.substr(low + 1, end + d.window - low))
        hit = F.array(F.struct(pair["found"].alias("match_text"), start.alias("start")))
        return F.struct(end.alias("at"), F.when(contains_any(near, d.keywords), F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("found")))
    test = contains_any(F.lower(text), d.keywords)
    test = test if d.name in DIGIT_FREE else test & has_digit(text)
    test = test & text.rlike(RUNS[d.name]) if d.name in RUNS else test
    return F.when(test & text.rlike(java(d)), F.aggregate(pairs, state, step, lambda acc: acc["out"])).otherwise(empty)


def count_matches(text: Column, d: Detector) -> Column:
    """The number of matches, before suppression; gated where the detector is."""
    return F.size(gated_matches(text, d)) if d.keywords else screened(text, d, F.regexp_count(text, F.lit(java(d))), F.lit(0))


def detect(df: DataFrame, text: str, path: Column, policy: Policy | None = None, keep: tuple[str, ...] = (), gated: bool = True) -> DataFrame:
    """One row for each finding: keep, path, pattern_name, match_text, line_number. Null text has none.

    Plain detectors look at each line, gated ones at the whole text.
    """
    policy = policy or select()
    base = df.select(*keep, path.alias("path"), F.col(text).cast("string").alias("_text")).where("_text IS NOT NULL")
    found = F.expr("CAST(array() AS array<struct<pattern_name:string,match_text:string>>)")
    found_by = lambda d: F.transform(matches_of(F.col("_line"), d), lambda m: F.struct(F.lit(d.name).alias("pattern_name"), m.alias("match_text")))
    lines = base.select(*keep, "path", F.posexplode(F.split("_text", LINE_ENDS, -1)).alias("_no", "_line"))
    all_found = F.flatten(by_digit(F.col("_line"), policy.plain, found_by, found)) if policy.plain else found
    plain = lines.select(*keep, "path", (F.col("_no") + 1).alias("line_number"), F.explode(all_found).alias("m")).select(*keep, "path", "m.pattern_name", "m.match_text", "line_number")
    out = plain
    if gated and policy.gated:

        def near_of(d: Detector) -> Column:
            return F.transform(gated_matches(F.col("_text"), d), lambda m: F.struct(F.lit(d.name).alias("pattern_name"), m["match_text"].alias("match_text"), m["start"].alias("start")))

        none = F.expr("CAST(array() AS array<struct<pattern_name:string,match_text:string,start:int>>)")
        near = F.flatten(by_digit(F.col("_text"), policy.gated, near_of, none))
        whole = base.select(*keep, "path", "_text", F.explode(near).alias("m"))
        line = (F.length(F.regexp_replace(F.expr("substring(_text, 1, m.start)"), "[^\\n]", "")) + 1).cast("int")
        out = plain.unionByName(whole.select(*keep, "path", "m.pattern_name", "m.match_text", line.alias("line_number")))
    return out.where(~suppressed(F.col("path"), F.col("pattern_name"), F.col("match_text")))
