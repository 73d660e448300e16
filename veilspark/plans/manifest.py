"""The audit manifest: counts over the actions of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of actions by line of the summary.
LINES = {
    "files_deleted": ("delete", "delete_directory", "delete_database"),
    "databases_sanitized": ("sanitize_database", "selective_db", "generic_sanitize", "platform_sanitize"),
    "plists_sanitized": ("plist_sanitize",),
    "exif_stripped": ("exif_strip",),
}


def manifest_summary(actions: DataFrame) -> DataFrame:
    """One row of counts; actions: action, and hash_before and hash_after where there are any."""
    hashes = [F.col(c).isNotNull() for c in ("hash_before", "hash_after") if c in actions.columns]
    hashed = F.lit(False)
    for h in hashes:
        hashed = hashed | h
    return actions.agg(*[F.count_if(F.col("action").isin(*names)).alias(line) for line, names in LINES.items()], F.count_if(hashed).alias("files_with_hashes"), F.count("*").alias("actions"))


def manifest(actions: DataFrame, scan: DataFrame, verdict: DataFrame) -> DataFrame:
    """One row (manifest string): the JSON of summary, scan and verification; all three are one row each."""
    one = manifest_summary(actions).select(F.struct("*").alias("summary"))
    whole = one.join(F.broadcast(scan.select(F.struct("*").alias("scan"))), F.lit(True)).join(F.broadcast(verdict.select(F.struct("*").alias("verification"))), F.lit(True))
    return whole.select(F.to_json(F.struct("summary", "scan", "verification")).alias("manifest"))


def exit_status(verdict: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """1 if the input or output failed (any row of errors), else 0 if verification passed, else 2."""
    failed = verdict.sparkSession.range(1).select(F.lit(False).alias("failed")) if errors is None else errors.agg((F.count("*") > 0).alias("failed"))
    return verdict.join(F.broadcast(failed), F.lit(True)).select(F.when(F.col("failed"), 1).when(F.col("passed"), 0).otherwise(2).alias("status"))  # one row each


def error_evidence(errors: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """errors: operation, table_name, column_name, never values. All of them counted (errors_count), and the first
    `most` in order as evidence: a bound that the record is to have."""
    counted = errors.agg(F.count("*").alias("errors_count"))
    return counted, errors.select("operation", "table_name", "column_name").orderBy("table_name", "column_name", "operation").limit(most)
