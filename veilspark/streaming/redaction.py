"""Redaction of streams: the batch projection, which keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veilspark.functions.policy import Policy
from veilspark.operators.redaction import redact_columns


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_redacted(stream: DataFrame, column: str, path: str, checkpoint: str, policy: Policy | None = None) -> StreamingQuery:
    """Appends redacted rows, once each, until the files there are read."""
    out = redact_columns(stream, {column: "types"}, policy)
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
