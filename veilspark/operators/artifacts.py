"""Files that are removed for what they are: caches, swap, crash reports, histories, key-value stores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.operators.paths import file_name


def _inside(low: Column, names: tuple[str, ...]) -> Column:
    """Whether a directory above the file has one of these names."""
    return low.rlike("(^|/)(" + "|".join(re.escape(n) for n in names) + ")/")


def _glob(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else re.escape(c) for c in pattern) + "$"


def artifact_kind(path: Column) -> Column:
    """cache, swap, crash, leveldb, artifact or null, by path alone."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    low, name = F.lower(slashes), file_name(slashes)
    lower_name = F.lower(name)
    cache = _inside(low, C.CACHE_DIRECTORIES) | low.rlike("(^|/)library/caches/") | lower_name.isin(*C.CACHE_FILES)
    swap = lower_name.isin(*C.SWAP_FILES) | lower_name.rlike("(" + "|".join(map(re.escape, C.SWAP_SUFFIXES)) + ")$") | name.rlike("^(" + "|".join(map(re.escape, C.SWAP_PREFIXES)) + ")")
    crash = _inside(low, C.CRASH_DIRECTORIES) | lower_name.rlike("(" + "|".join(map(re.escape, C.CRASH_SUFFIXES)) + ")$")
    leveldb = low.rlike("(^|/)[^/]*leveldb/")
    artifact = slashes.rlike("(^|/)(" + "|".join(map(re.escape, C.ARTIFACT_DIRECTORIES)) + ")/") | name.isin(*C.ARTIFACT_FILES) | name.rlike("|".join(_glob(p) for p in C.ARTIFACT_PATTERNS))
    return F.when(leveldb, "leveldb").when(cache, "cache").when(swap, "swap").when(crash, "crash").when(artifact, "artifact")


def leveldb_stores(files: DataFrame) -> DataFrame:
    """(directory) that hold a CURRENT file and a data file, whatever their name."""
    slashes = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    name = file_name(slashes)
    data = name.rlike(r"\.(ldb|sst|log)$|^MANIFEST-")
    return files.where((name == "CURRENT") | data).groupBy(F.regexp_replace(slashes, "/?[^/]*$", "").alias("directory")).agg(F.bool_or(name == "CURRENT").alias("current"), F.bool_or(data).alias("data")).where("current AND data").select("directory")


def artifact_actions(files: DataFrame) -> DataFrame:
    """(action, path) for the files that go."""
    return files.withColumn("kind", artifact_kind(F.col("path"))).where("kind IS NOT NULL").select(F.concat(F.lit("delete_"), "kind").alias("action"), "path")
