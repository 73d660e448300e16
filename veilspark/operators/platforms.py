"""Databases of known kinds: told by their tables, with tables to empty and columns to redact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.policy import Policy
from veilspark.functions.safe_harbor import Profile
from veilspark.operators.tables import Sanitized, sanitize_table


def detect_platforms(tables: DataFrame) -> DataFrame:
    """tables: db, table_name. (db, db_type): the first kind all of whose tables are there; null without any."""
    spark = tables.sparkSession
    wanted = [(i, kind, sorted(n.lower() for n in names)) for i, (kind, names) in enumerate(C.SIGNATURES)]
    parts = spark.createDataFrame([(i, kind, n, len(names)) for i, kind, names in wanted for n in names], "position int, db_type string, table_name string, needed int")  # a few rows for each kind
    low = tables.select("db", F.lower("table_name").alias("table_name")).distinct()
    full = low.join(F.broadcast(parts), "table_name").groupBy("db", "position", "db_type", "needed").agg(F.count("*").alias("n")).where("n = needed")
    first = full.groupBy("db").agg(F.min_by("db_type", "position").alias("db_type"))
    return tables.select("db").distinct().join(first, "db", "left")


def emptied_tables(tables: DataFrame) -> DataFrame:
    """(db, db_type, table_name) of the tables to empty."""
    spark = tables.sparkSession
    rule = spark.createDataFrame([(kind, n.lower()) for kind, names in C.EMPTIED_TABLES.items() for n in names], "db_type string, low string")
    return tables.join(detect_platforms(tables).where("db_type IS NOT NULL"), "db").withColumn("low", F.lower("table_name")).join(F.broadcast(rule), ["db_type", "low"], "left_semi").select("db", "db_type", "table_name")


def handle_table(df: DataFrame, db_type: str, table: str) -> DataFrame:
    """A table of a known kind of database after its handler: emptied, redacted by column, or as it is."""
    low = table.lower()
    if low in {n.lower() for n in C.EMPTIED_TABLES.get(db_type, ())}:
        return df.limit(0)
    for name, columns, put in C.REDACTED_COLUMNS.get(db_type, ()):
        if name.lower() == low:
            wanted = {c.lower() for c in columns}
            df = df.withColumns({c: F.when(F.col(c).isNotNull(), put) for c in df.columns if c.lower() in wanted})
    if db_type == "knowledgec" and low == "zobject":
        df = knowledge_rows(df)
    return df


@dataclass(frozen=True)
class SanitizedDatabase:
    """db_type: the kind that was told, or none. tables: by name, after its handler and the sweep of what it left."""

    db_type: str | None
    tables: dict[str, Sanitized]


def sanitize_database(tables: dict[str, DataFrame], policy: Policy | None = None, profile: Profile | None = None, gated: bool = True) -> SanitizedDatabase:
    """The tables of one database by name. Its kind is told by their names; the handler of that kind comes first, then
    every table that it did not empty is swept like one of an unknown database. One name a table is collected."""
    spark = next(iter(tables.values())).sparkSession if tables else None
    if spark is None:
        return SanitizedDatabase(None, {})
    names = spark.createDataFrame([("db", t) for t in tables], "db string, table_name string")
    db_type = detect_platforms(names).first().db_type
    emptied = {n.lower() for n in C.EMPTIED_TABLES.get(db_type, ())}
    done = {}
    for name, df in tables.items():
        if name.lower() in emptied:
            n = df.select(F.count("*").alias("events"))
            done[name] = Sanitized(df.limit(0), n.select(F.lit("*").alias("column_name"), "events"), n.where("events > 0").select(F.lit(f"pii_table:{name}").alias("evidence")))
        else:
            done[name] = sanitize_table(handle_table(df, db_type, name) if db_type else df, name, policy, profile, gated)
    return SanitizedDatabase(db_type, done)


def knowledge_rows(df: DataFrame) -> DataFrame:
    """Streams of certain kinds go; values other than the system's own names are redacted."""
    names = {c.lower(): c for c in df.columns}
    stream, value = F.col(names["zstreamname"]), F.col(names["zvaluestring"])
    gone: Column = stream.ilike("%safari%") | stream.ilike("%siri%") | stream.ilike("%messaging%")
    return df.where(~F.coalesce(gone, F.lit(False))).withColumn(names["zvaluestring"], F.when(value.isNotNull() & ~value.ilike("com.apple.%"), "[REDACTED]").otherwise(value))
