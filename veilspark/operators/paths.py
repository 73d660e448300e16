"""Rules over file paths: what a file is and what happens to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import catalog as C


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def classify(path: Column, jailbreak_prefixes: tuple[str, ...] = (), outside: bool = False) -> Column:
    """Struct (action, reason): the first rule that holds. outside: a jailbreak root lies outside the tree, so that
    markers inside a path count."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = file_name(low)
    cases: list[tuple[Column, str, str]] = []
    if outside:
        cases.append((_any([F.contains(low, F.lit(m)) for m in C.JAILBREAK_MARKERS]), "PRESERVE", "jailbreak infrastructure"))
    cases += [(F.startswith(low, F.lit(p.lower())), "PRESERVE", "jailbreak infrastructure") for p in jailbreak_prefixes]
    cases += [(F.startswith(low, F.lit(p.lower().lstrip("/"))), "PRESERVE", f"system: {p}") for p in C.PRESERVED_PREFIXES]
    cases += [(F.endswith(low, F.lit(p.lower())), "SELECTIVE_DB", f"mixed db: {n}") for p, n in C.MIXED_DATABASES]
    cases += [(F.contains(low, F.lit(p.lower().lstrip("/"))), "DELETE", f"personal data: {p}") for p in C.PERSONAL_DIRECTORIES]
    cases += [(name == n.lower(), "DELETE", f"personal database: {n}") for n in C.PERSONAL_FILES]
    cases += [(name == n.lower(), "DELETE", f"wifi credentials: {n}") for n in C.NETWORK_FILES]
    cases += [(F.endswith(low, F.lit(s)) & F.contains(low, F.lit(C.MEDIA_SCOPE)), "EXIF_STRIP" if s in C.STRIPPED_SUFFIXES else "DELETE", f"media in {C.MEDIA_SCOPE}") for s in C.MEDIA_SUFFIXES]
    cases += [(F.endswith(low, F.lit(".plist")) & F.contains(low, F.lit(p.lower().lstrip("/"))), "PLIST_SANITIZE", f"plist: {p}") for p in C.PLIST_DIRECTORIES]
    put = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    first, *rest = cases
    out = F.when(first[0], put(*first[1:]))
    for test, action, reason in rest:
        out = out.when(test, put(action, reason))
    return out.otherwise(put("PRESERVE", "unclassified (default preserve)"))


def scan(files: DataFrame, **kw) -> DataFrame:  # noqa: ANN003
    """files: path, length. Adds action and reason."""
    return files.withColumn("_c", classify(F.col("path"), **kw)).select("path", F.col("length").alias("size"), "_c.action", "_c.reason")


def summary(classified: DataFrame) -> DataFrame:
    """One row: files, bytes, deleted and preserved files, bytes deleted, and whether the tree looks like a device's
    (only then do classifications take effect)."""
    deleted = F.col("action") == "DELETE"
    return classified.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count_if(deleted).alias("delete_count"),
        F.count_if(F.col("action") == "PRESERVE").alias("preserve_count"), F.coalesce(F.sum(F.when(deleted, F.col("size"))), F.lit(0)).alias("delete_size"),
        F.coalesce(F.bool_or(F.startswith("reason", F.lit("system:")) | (F.col("reason") == "jailbreak infrastructure")), F.lit(False)).alias("acted_on"),
    )


def histogram(classified: DataFrame) -> DataFrame:
    return classified.groupBy("action").agg(F.count("*").alias("n"))


def jailbreak(files: DataFrame) -> DataFrame:
    """One row: detected and type, told from the paths alone."""
    low = F.lower("path")
    seen = lambda p: F.coalesce(F.bool_or(low.rlike(p)), F.lit(False))
    flags = files.agg(seen("^private/var/jb(/|$)").alias("root"), seen("^private/var/jb-[^/]*/").alias("hidden"), seen("^private/preboot/.*dopamine").alias("dopamine"), seen("^private/preboot/.*(palera1n|jbinit)|^cores/jbinit\\.log$").alias("palera1n"))
    kind = F.when(F.col("palera1n"), "palera1n").when(F.col("dopamine"), "dopamine").when(F.col("hidden"), "roothide").when(F.col("root"), "unknown").otherwise("")
    return flags.select((F.col("root") | F.col("hidden") | F.col("dopamine") | F.col("palera1n")).alias("detected"), kind.alias("type"))


def text_kind(path: Column) -> Column:
    """history, json, log, csv or null."""
    name = F.lower(file_name(path))
    suffix = F.when(name.rlike(r"\.[^.]+$"), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    return F.when(name.isin(*C.HISTORY_FILES), "history").when(suffix == ".json", "json").when(suffix.isin(*C.LOG_SUFFIXES), "log").when(suffix.isin(".csv", ".tsv"), "csv")


def size_partition(files: DataFrame, limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Text files within their kind's limit, and actions for those that are larger or whose size is unknown."""
    limits = limits or C.SIZE_LIMITS
    typed = files.withColumn("kind", text_kind(F.col("path"))).where("kind IS NOT NULL")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("kind"))
    fits = (F.col("kind") == "history") | F.coalesce(F.col("length") <= limit, F.lit(False))
    skipped = typed.where(~fits).select(F.lit("text_sanitize_skipped").alias("action"), "path", F.coalesce(F.concat(F.lit("size "), F.col("length").cast("string")), F.lit("size unknown")).alias("error"))
    return typed.where(fits), skipped


def is_database(path: Column, head: Column) -> Column:
    """By suffix, or by the first six bytes."""
    return F.lower(path).rlike(r"\.(" + "|".join(s[1:] for s in C.DATABASE_SUFFIXES) + ")$") | F.coalesce(F.substring(head, 1, 6) == F.lit(b"SQLite"), F.lit(False))


def not_done(files: DataFrame, actions: DataFrame, action: str) -> DataFrame:
    """files without those that an action of this name without an error has already taken."""
    done = actions.where((F.col("action") == action) & F.col("error").isNull()).select("path") if "error" in actions.columns else actions.where(F.col("action") == action).select("path")
    return files.join(done, "path", "left_anti")


def outside(files: DataFrame, directories: DataFrame) -> DataFrame:
    """files (path) that lie in none of the directories (path), at any depth. Joined on the directories above a file,
    so that neither side has to fit in memory."""
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    inside = files.where(F.size(parts) > 1).select("path", F.explode(above).alias("_above")).join(directories.select(F.rtrim(F.col("path"), F.lit("/")).alias("_above")), "_above", "left_semi").select("path")
    return files.join(inside, "path", "left_anti")


def companion_actions(files: DataFrame) -> DataFrame:
    """(action, path) for the files that a database engine leaves beside a database: delete_companion where the
    database is there, delete_orphan where it is not."""
    found = files.where(F.lower("path").rlike("-(wal|shm|journal)$")).select("path", F.regexp_replace("path", "(?i)-(wal|shm|journal)$", "").alias("_base"))
    there = files.select(F.col("path").alias("_base"), F.lit(True).alias("_there")).distinct()
    return found.join(there, "_base", "left").select(F.when(F.col("_there"), "delete_companion").otherwise("delete_orphan").alias("action"), "path")


def container_actions(files: DataFrame, acted_on: bool = True) -> DataFrame:
    """(action, path, reason) for each directory of an app: apps of certain names, told by any name inside, are kept,
    all others go. Only files directly in a device's tree have such directories (acted_on)."""
    root = C.APP_CONTAINERS + "/"
    low = F.lower("_rest")
    split = files.where(F.startswith("path", F.lit(root)) & F.lit(acted_on)).select(F.substring_index(F.substr("path", F.lit(len(root) + 1)), "/", 1).alias("_app"), F.substr("path", F.lit(len(root) + 1)).alias("_path"))
    inner = split.where("_path <> _app AND _app <> ''").select("_app", F.substr("_path", F.length("_app") + 2).alias("_rest"))
    kept = F.bool_or(_any([F.contains(low, F.lit(n.lower())) for n in C.KEPT_APPS]))
    apps = inner.groupBy("_app").agg(kept.alias("_kept"))
    return apps.select(F.when(F.col("_kept"), "preserve").otherwise("delete_directory").alias("action"), F.concat(F.lit(root), "_app").alias("path"), F.when(F.col("_kept"), "jailbreak app").otherwise("third-party app").alias("reason"))


def times_normalized(files: DataFrame, epoch: str = "2000-01-01") -> DataFrame:
    """One row for the manifest: the time (midnight, UTC) that every file and the tree itself would be given."""
    days = F.unix_date(F.to_date(F.lit(epoch), "yyyy-MM-dd"))
    return files.agg(F.count("*").alias("n")).select(F.lit("normalize_timestamps").alias("action"), F.lit(epoch).alias("epoch"), (days.cast("long") * 86_400).alias("epoch_ts"), (F.col("n") + 1).alias("files_normalized"))


def foreign_databases(files: DataFrame) -> DataFrame:
    """(check, path, reason): databases of a format that nothing here reads, so that a verdict can't pass over them."""
    return files.where(F.lower(file_name(F.col("path"))).isin(*[n.lower() for n in C.FOREIGN_DATABASES])).select(F.lit("database").alias("check"), "path", F.lit("a format that is not read: delete it, or convert it first").alias("reason"))
