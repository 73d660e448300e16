"""Sources and sinks."""

from __future__ import annotations

import plistlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalog as C


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (below root), length, modificationTime and content of all files; files that vanish are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted(base) + "/", "")
    return found.withColumn("path", relative) if content else found.drop("content").withColumn("path", relative)


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python in batches of a few MB, whatever the length of texts; a smaller setting of the session stays."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        found = spark.conf.get(name, None)
        if not (found and found.isdigit() and 0 < int(found) <= most):
            spark.conf.set(name, str(most))
    return spark


#: Rows of a task of a table that is dealt anew.
SPREAD_ROWS = 200_000


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its rows come in fewer partitions than there are, or one has far more than its share of
    them: a file's row groups are not cut, so that one large group is one task, however many partitions there are. Other inputs stay as they are."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts < cores:
        rows = df.count()  # from the files' footers
    else:
        sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        rows = sum(sizes)
        if len(sizes) >= cores and 2 * max(sizes) * cores <= 3 * rows or not rows:
            return df
    return df.repartition(max(cores, parts, -(-rows // SPREAD_ROWS)))


def texts(found: DataFrame) -> DataFrame:
    """path, length, text: the content as UTF-8 without what is invalid."""
    return found.select("path", "length", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))


def hashed(found: DataFrame) -> DataFrame:
    return found.withColumn("sha256", F.sha2("content", 256))


SEPARATORS = (",", ";", "\t", "|")


def separator_of(spark: SparkSession, path: str, lines: int = 64) -> str:
    """The separator that stands equally often in some lines of a CSV file, outside of quotes; the most frequent one
    of several; a comma where none does."""
    some = spark.read.text(path).where("trim(value) <> ''").limit(lines)
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in SEPARATORS]
    row = some.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(counts) for k, f in (("least", F.min), ("most", F.max))]).first()
    steady = {s: (row[f"least{i}"] == row[f"most{i}"], row[f"least{i}"]) for i, s in enumerate(SEPARATORS) if row[f"least{i}"]}
    return max(steady, key=lambda s: steady[s], default=",")


def read_csv(spark: SparkSession, path: str, separator: str | None = ",") -> DataFrame:
    """All strings; a separator of None is told from the file."""
    separator = separator_of(spark, path) if separator is None else separator
    return spark.read.csv(path, header=True, inferSchema=False, sep=separator, mode="PERMISSIVE")


def write_new(df: DataFrame, path: str) -> None:
    """Never overwrites."""
    df.write.mode("errorifexists").parquet(path)


def os_version(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """found: path, content, and `by`, the columns that tell trees apart. The version that a tree's system file
    states, or "unknown"; one row a tree."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return pd.Series([_version(c) for c in contents], dtype=object)

    trees = found.groupBy(*by).agg(F.count("*").alias("_n"))
    told = found.where((F.col("path") == C.VERSION_FILE) & F.col("content").isNotNull()).select(*by, read("content").alias("_version")).groupBy(*by).agg(F.max("_version").alias("_version"))
    both = trees.join(told, list(by), "left") if by else trees.join(F.broadcast(told), F.lit(True))
    return both.select(*by, F.coalesce("_version", F.lit("unknown")).alias("version"))


def _version(content: bytes) -> str | None:
    try:
        value = plistlib.loads(bytes(content)).get(C.VERSION_KEY)
    except Exception:  # not a property list, or not a dictionary
        return None
    return value if isinstance(value, str) else None
