"""Verification after redaction: findings, checks that could not run, and one verdict. It fails closed."""

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import catalog as C
from veilspark.functions.columns import named
from veilspark.functions.policy import Policy, select
from veilspark.operators.detection import detect
from veilspark.sources.files import bounded_batches

MATCH = "path string, pattern_name string, match_text string, line_number int"


@dataclass(frozen=True)
class Verification:
    """matches: path, pattern_name, match_text, line_number. incomplete: check, path, reason. verdict: one row."""

    matches: DataFrame
    incomplete: DataFrame
    verdict: DataFrame


def scan_files(files: DataFrame, policy: Policy | None = None, limit: int = C.SCAN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """files: path, length, text (null where it could not be read). Findings, and files too large or unreadable.

    Only text suffixes are looked at; manifests and system paths are left out before sizes are."""
    low = F.lower("path")
    name = F.substring_index("path", "/", -1)
    system = reduce(lambda a, b: a | b, [F.contains(F.col("path"), F.lit(p)) for p in C.SYSTEM_PATHS])
    scanned = files.where(low.rlike(r"\.(" + "|".join(s[1:] for s in C.SCANNED_SUFFIXES) + ")$") & ~name.isin("manifest.json", "manifest.txt") & ~system)
    large = scanned.where(F.col("length") > limit).select(F.lit("text_scan").alias("check"), "path", F.concat(F.lit("over the scan limit: "), F.col("length").cast("string")).alias("reason"))
    unread = scanned.where((F.col("length") <= limit) & F.col("text").isNull()).select(F.lit("text_scan").alias("check"), "path", F.lit("unreadable").alias("reason"))
    return detect(scanned.where(F.col("length") <= limit), "text", F.col("path"), policy), large.unionByName(unread)


def texts_of(value: Column, kind: T.DataType) -> Column | None:
    """All texts inside a value of any type, as an array; null where nothing looks into such a type. Truth values hold no text."""
    empty = F.expr("CAST(array() AS array<string>)")
    if isinstance(kind, T.BinaryType):
        return F.coalesce(decode_variants(value), empty)
    if isinstance(kind, T.BooleanType) or isinstance(kind, T.NullType):
        return empty
    if isinstance(kind, T.AtomicType):
        return F.when(value.isNotNull(), F.array(value.cast("string"))).otherwise(empty)
    if isinstance(kind, T.StructType):
        inner = [texts_of(value[f.name], f.dataType) for f in kind.fields]
        return None if any(x is None for x in inner) else F.coalesce(F.concat(*inner), empty) if inner else empty
    if isinstance(kind, T.MapType):
        keys, values = texts_of(F.map_keys(value), T.ArrayType(kind.keyType)), texts_of(F.map_values(value), T.ArrayType(kind.valueType))
        return None if keys is None or values is None else F.coalesce(F.concat(keys, values), empty)
    if isinstance(kind, T.ArrayType):
        if texts_of(value, kind.elementType) is None or _holds_binary(kind.elementType):  # Python takes no part in a lambda
            return None
        return F.coalesce(F.flatten(F.transform(value, lambda x: texts_of(x, kind.elementType))), empty)
    return None


def _holds_binary(kind: T.DataType) -> bool:
    return isinstance(kind, T.BinaryType) or any(_holds_binary(k) for k in (getattr(kind, "elementType", None), getattr(kind, "keyType", None), getattr(kind, "valueType", None), *(f.dataType for f in getattr(kind, "fields", ()))) if k is not None)


def scan_table(df: DataFrame, table: str, policy: Policy | None = None) -> DataFrame:
    """Findings in all columns, at paths table.column: nested values by what they hold, binary ones as UTF-8 and UTF-16."""
    cells = {f.name: texts_of(F.col(named(f.name)), f.dataType) for f in df.schema.fields}
    cells = {c: x for c, x in cells.items() if x is not None}
    if not cells:
        return df.sparkSession.createDataFrame([], MATCH)
    bounded_batches(df.sparkSession)  # of binary values, which Python decodes
    plain = df.select(*[x.alias(f"c{i}") for i, x in enumerate(cells.values())])
    long = plain.select(F.explode(F.array(*[F.struct(F.lit(f"{table}.{c}").alias("path"), F.col(f"c{i}").alias("texts")) for i, c in enumerate(cells)])).alias("c")).select("c.path", F.explode("c.texts").alias("value"))
    return detect(long, "value", F.col("path"), policy)


def unscanned_columns(df: DataFrame, table: str) -> DataFrame:
    """(check, path, reason) of the columns into which scan_table doesn't look."""
    rows = [("table_scan", f"{table}.{f.name}", f"no texts are read from {f.dataType.simpleString()}") for f in df.schema.fields if texts_of(F.col(named(f.name)), f.dataType) is None]
    return df.sparkSession.createDataFrame(rows, "check string, path string, reason string")


def verify_table(df: DataFrame, table: str, policy: Policy | None = None) -> Verification:
    """scan_table, and no pass while a column is not looked into."""
    return verify(scan_table(df, table, policy), unscanned_columns(df, table), table)


@F.pandas_udf(T.ArrayType(T.StringType()))
def decode_variants(values: pd.Series) -> pd.Series:
    """The texts that a binary value may hold, read as UTF-8 and as UTF-16 without what is invalid; null for null."""
    return values.map(lambda raw: None if raw is None else list(dict.fromkeys(raw.decode(e, "ignore") for e in ("utf-8", "utf-16"))))


def verify(matches: DataFrame, incomplete: DataFrame | None = None, scope: str | None = None) -> Verification:
    """passed only if there is no finding and every check could run."""
    spark = matches.sparkSession
    incomplete = spark.createDataFrame([], "check string, path string, reason string") if incomplete is None else incomplete
    found = matches.agg(F.count("*").alias("total_findings"))
    missed = incomplete.agg(F.count("*").alias("incomplete"))
    # two one-row tables
    verdict = found.join(F.broadcast(missed), F.lit(True)).select(((F.col("total_findings") == 0) & (F.col("incomplete") == 0)).alias("passed"), F.lit(True).alias("performed"), F.lit(scope).cast("string").alias("scope"), "total_findings", "incomplete")
    return Verification(matches, incomplete, verdict)


def verify_column(df: DataFrame, text: str, path: str, policy: Policy | None = None) -> Verification:
    policy = policy or select()
    return verify(detect(df, text, F.lit(path), policy))


def integrity(before: DataFrame, after: DataFrame, path: str, emptied: bool = False) -> DataFrame:
    """(check, path, reason) where a table lost or gained rows or columns; an emptied one is to have none left."""
    reasons = [] if before.columns == after.columns else ["columns differ"]
    n = before.agg(F.count("*").alias("_before")).join(F.broadcast(after.agg(F.count("*").alias("_after"))), F.lit(True))  # one row each
    wrong = F.col("_after") != (F.lit(0) if emptied else F.col("_before"))
    rows = n.where(wrong).select(F.lit("integrity").alias("check"), F.lit(path).alias("path"), F.concat_ws(" ", F.lit("rows:"), F.col("_before").cast("string"), F.lit("before,"), F.col("_after").cast("string"), F.lit("after")).alias("reason"))
    return rows.unionByName(before.sparkSession.createDataFrame([("integrity", path, r) for r in reasons], "check string, path string, reason string"))
