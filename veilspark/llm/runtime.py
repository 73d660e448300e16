"""Shared Spark plumbing: written stages, bucketed ranks and skew-proof joins."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.sources.files import bounded_batches

_written: list[tuple[SparkSession, str]] = []
#: Whether Spark drops the shuffle files of an execution at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset a local master, as in tests, gets a
    folder of its own; a cluster has to name one, since its executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before
            return


atexit.register(_sweep)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors.

    Shuffle files of the write go when it has ended: nothing reads them again. Tables go when the driver process ends.
    """
    spark = bounded_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/veilspark-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    _written.append((spark, path.rsplit("/", 1)[0]))
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> str:
    """A column's name as an identifier."""
    return "`" + column.replace("`", "``") + "`"


def fresh_name(df: DataFrame, base: str) -> str:
    """A name like `base` that df does not use, in any case."""
    used = {c.lower() for c in df.columns}
    while base.lower() in used:
        base += "_"
    return base


def batches(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about `limit` bytes together; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(size)
    lo, n = 0, len(size)
    while lo < n:
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, min(hi, n)
        lo = hi


def release() -> None:
    """Gives the process's freed memory back to the system, where the C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving its memory back at its end: Python workers live on, and would hold it while later stages run."""

    def whole(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(frames)
        release()

    return whole


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before a row of its group, in the order of (bucket, *order).

    No group meets in one task: buckets are summed with partial aggregation, their running sums are taken over
    one row for each bucket, and a window runs inside (group, bucket). Group columns hold no nulls.
    """
    keyed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_total")).withColumn("_start", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    before = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(starts, [*group, "_bucket"]).withColumn(out, (F.col("_start") + F.coalesce(F.sum("_value").over(before), F.lit(0))).cast("long")).drop("_bucket", "_value", "_start")


def buckets(rows: int) -> int:
    """How many hash buckets keep a bucket of `rows` rows near 20,000, at any size."""
    return max(256, rows // 20_000)


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """So many shuffle partitions that one gets about `each` rows at most; the session's number where that is enough."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def join_salted(many: DataFrame, one: DataFrame, key: str, rows: str, total: int, salt: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """many joined to the one row for each key of `one`; no key meets in one task.

    rows: a column of `one` with the number of rows that the key has in `many`; total: rows of `many`. At most
    1,000 keys can have a thousandth of the rows; only those, broadcast, are spread over `salts` copies.
    """
    hot = F.broadcast(one.where(F.col(rows) >= max(2, total // 1000)).select(key, F.lit(True).alias("_hot")))
    left = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(salt, F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col(rows) >= max(2, total // 1000), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(one.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")
