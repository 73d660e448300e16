"""Sanitizing tables: sensitive columns, emptied tables, detectors in every other column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.columns import named
from veilspark.functions.policy import Policy, select
from veilspark.functions.pytext import redact_text
from veilspark.functions.safe_harbor import Profile, transform_value
from veilspark.operators.redaction import redact_columns

REDACTED = "[REDACTED]"


@dataclass(frozen=True)
class Sanitized:
    """rows: the table after it. counts: one row with redacted events by column. evidence: rows (evidence string)."""

    rows: DataFrame
    counts: DataFrame
    evidence: DataFrame


def redact_sensitive(value: Column) -> Column:
    """The whole value, unless it is null or empty."""
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.lit(REDACTED)).otherwise(value.cast("string"))


def number_redactions(df: DataFrame, column: str, row_id: str, groups: int = 256) -> DataFrame:
    """Distinct redactions [REDACTED_i] for a column that has to stay unique: i counts the values that are not null,
    in the order of row_id; empty values count and stay. Counted by ranges, so that no task takes the whole table."""
    cuts = df.where(F.col(column).isNotNull()).agg(F.percentile_approx(row_id, [i / groups for i in range(1, groups)], 10_000)).first()[0]
    part = reduce(lambda acc, cut: acc + F.when(F.col(row_id) > F.lit(cut), 1).otherwise(0), sorted(set(cuts or ())), F.lit(0))
    parted = df.withColumn("_part", part)
    sizes = {r._part: r.n for r in parted.groupBy("_part").agg(F.count(column).alias("n")).collect()}
    before, starts = 0, {}
    for p in sorted(sizes):
        starts[p], before = before, before + sizes[p]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part")) if starts else F.lit(0)
    inside = F.count(column).over(Window.partitionBy("_part").orderBy(row_id).rowsBetween(Window.unboundedPreceding, -1))
    value = F.col(column).cast("string")
    return parted.withColumn(column, F.when(value.isNotNull() & (value != ""), F.concat(F.lit("[REDACTED_"), (start + inside).cast("string"), F.lit("]"))).otherwise(value)).drop("_part")


def redact_bytes(df: DataFrame, columns: dict[str, str], policy: Policy) -> DataFrame:
    """df with binary columns redacted where detectors fire on them read as UTF-8, or else as UTF-16, without what is
    invalid, and written back as such; other values stay to the byte. Adds the detectors that fired, as named."""

    @F.pandas_udf("value binary, types array<string>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows: list[tuple[bytes | None, list[str]]] = []
        for raw in values:
            done: tuple[bytes | None, list[str]] = (raw, [])
            for encoding in ("utf-8", "utf-16") if raw is not None else ():
                text, types = redact_text(raw.decode(encoding, "ignore"), policy)
                if types:
                    done = (text.encode(encoding, "ignore"), types)
                    break
            rows.append(done)
        return pd.DataFrame(rows, columns=["value", "types"])

    for c, t in columns.items():
        df = df.withColumn(t, run(F.col(named(c)))).withColumns({c: F.col(t)["value"], t: F.col(t)["types"]})
    return df


def sanitize_table(df: DataFrame, name: str, policy: Policy | None = None, profile: Profile | None = None, gated: bool = False) -> Sanitized:
    """One projection over all columns; the schema's names stay.

    A table whose name is personal loses its rows. Columns with sensitive names go whole; every other column is
    text, and detectors apply; binary columns stay binary. Nested columns and truth values pass as they are: a
    verification looks into them. One pass is a fixpoint: later passes would look only at values without a redaction,
    in all of which no detector fires any more. The three tables are lazy and share no work: where more than one is
    used, write rows and evidence from a checkpointed table.
    """
    policy = policy or select()
    if profile:
        policy = policy.extended(profile.columns, profile.tables)
    spark = df.sparkSession
    if name.lower() in policy.tables:
        n = df.select(F.count("*").alias("n"))
        evidence = n.where("n > 0").select(F.lit(f"pii_table:{name}").alias("evidence"))
        return Sanitized(df.limit(0), n.select(F.lit("*").alias("column_name"), F.col("n").alias("events")), evidence)
    general = {c for c in df.columns if profile and _generalized(c, profile)}
    whole = [c for c in df.columns if c.lower() in policy.columns and c not in general]
    kinds = dict(df.dtypes)
    scanned = [c for c in df.columns if c not in whole and c not in general and kinds[c].split("<")[0] not in ("array", "map", "struct", "boolean")]
    types = {c: f"_types_{i}" for i, c in enumerate(scanned)}
    binary = {c: t for c, t in types.items() if kinds[c] == "binary"}
    out = redact_columns(redact_bytes(df, binary, policy), {c: t for c, t in types.items() if c not in binary}, policy, gated)
    flags = {c: F.col(named(c)).isNotNull() & (F.col(named(c)).cast("string") != "") for c in whole}
    marked = out.withColumns({f"_whole_{i}": flags[c] for i, c in enumerate(whole)})
    done = marked.withColumns({c: redact_sensitive(F.col(named(c))) for c in whole} | {c: transform_value(c, F.col(named(c)), profile) for c in general})
    sums = [F.sum(F.size(types[c])).alias(f"s{i}") for i, c in enumerate(scanned)] + [F.count_if(F.coalesce(F.col(f"_whole_{i}"), F.lit(False))).alias(f"w{i}") for i in range(len(whole))]
    counts = done.agg(*sums) if sums else spark.range(1).select()
    pairs = [F.struct(F.lit(c).alias("column_name"), F.coalesce(f"s{i}", F.lit(0)).cast("long").alias("events")) for i, c in enumerate(scanned)] + [F.struct(F.lit(c).alias("column_name"), F.col(f"w{i}").cast("long").alias("events")) for i, c in enumerate(whole)]
    by_column = counts.select(F.inline(F.array(*pairs))) if pairs else spark.createDataFrame([], "column_name string, events long")
    found = F.flatten(F.array(*[F.col(t) for t in types.values()], *[F.when(F.col(f"_whole_{i}"), F.array(F.lit(f"sensitive_column:{c.lower()}"))).otherwise(F.expr("CAST(array() AS array<string>)")) for i, c in enumerate(whole)]))
    evidence = done.select(F.explode(found).alias("evidence")).distinct() if types or whole else spark.createDataFrame([], "evidence string")
    return Sanitized(done.select(*[F.col(named(c)) for c in df.columns]), by_column, evidence)


def _generalized(name: str, profile: Profile) -> bool:
    from veilspark.functions.catalog import DATE_COLUMNS, ZIP_COLUMNS

    return profile.zips and name.lower() in ZIP_COLUMNS or profile.dates and name.lower() in DATE_COLUMNS
