"""The registered queries of the engine, with SQL that states the same result for another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.columns import has_digit, java
from veilspark.functions.policy import listing, select
from veilspark.functions.safe_harbor import generalize_date, profile, transform_value, truncate_zip
from veilspark.functions.suppression import suppressed
from veilspark.operators import artifacts, carriers, coverage, detection, paths, platforms, redaction, rules, tables, verification
from veilspark.plans import manifest
from veilspark.sources import files
from veilspark.sources.files import bounded_batches, spread
from veilspark.streaming import redaction as streaming

Query = Callable[[SparkSession, str], DataFrame]
COMMON = ("email", "phone_us", "imsi", "credit_card")
#: Look-around for engines that have none: the first octet, and the first three digits, by enumeration.
PORTABLE = {
    "ip_v4": r"\b(?:[1-9]|\d\d|[03-9]\d\d|1(?:[013-9]\d|2[0-689])|2(?:[0-46-9]\d|5[0-46-9]))\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "ssn": r"\b(?:00[1-9]|0[1-9]\d|[1-57-8]\d\d|6(?:[0-57-9]\d|6[0-57-9]))[-\s]?\d{2}[-\s]?\d{4}\b",
}
#: A pattern with word bounds that would differ between Unicode and ASCII: separators are doubled and stand for the bounds.
BOUND = {"swift_bic": r"(?:^|[^\p{L}\p{N}_])([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)(?:$|[^\p{L}\p{N}_])"}
COUNTED = tuple(d for d in C.DETECTORS if not d.keywords and d.name not in ("uk_nin", "ip_v6", "npi"))


#: Tables whose texts make the work of a query.
TEXT_TABLES = ("documents", "pages", "conversations", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def by_name(name: str) -> C.Detector:
    return next(d for d in C.DETECTORS if d.name == name)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_pattern(d: C.Detector) -> str:
    return quoted(("(?i)" if d.ignore_case else "") + PORTABLE.get(d.name, d.pattern))


def sql_found(d: C.Detector, text: str = "text") -> str:
    if d.name in BOUND:
        doubled = f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
        return f"regexp_extract_all({doubled}, {quoted(BOUND[d.name])}, 1)"
    return f"regexp_extract_all({text}, {sql_pattern(d)})"


def histogram(df: DataFrame, text: str, detectors: tuple[C.Detector, ...], *by: str) -> DataFrame:
    """Matches by detector (and columns): one scan, one row for each detector and group before the shuffle."""
    marked = df.select(*by, F.col(text).alias("_text"), has_digit(F.col(text)).alias("_digit"))
    count = lambda d: detection.count_matches(F.col("_text"), d)
    counts = [count(d) if d.name in C.DIGIT_FREE else F.when(F.col("_digit"), count(d)) for d in detectors]
    sums = marked.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(d.name) for d, n in zip(detectors, counts, strict=True)])
    return sums.select(*by, F.inline(F.array(*[F.struct(F.lit(d.name).alias("pattern_name"), F.col(d.name).alias("n")) for d in detectors])))


def sql_histogram(name: str, text: str, detectors: tuple[C.Detector, ...], *by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return " UNION ALL ".join(f"SELECT {keys}{quoted(d.name)} AS pattern_name, CAST(coalesce(sum(len({sql_found(d, text)})), 0) AS BIGINT) AS n FROM {name}{group}" for d in detectors)


def found_column(df: DataFrame, name: str) -> DataFrame:
    return df.select("doc_id", F.explode(detection.matches_of(F.col("text"), by_name(name))).alias("match_text"))


def suppression_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = found_column(table(spark, sf_dir, "documents"), name)
        return found.select("doc_id", "match_text", suppressed(F.lit("documents.body"), F.lit(name), F.col("match_text")).alias("suppressed"))

    return run


def sql_suppression(name: str, rule: str) -> str:
    return f"SELECT doc_id, match_text, coalesce({rule}, false) AS suppressed FROM (SELECT doc_id, unnest({sql_found(by_name(name))}) AS match_text FROM documents)"


def sql_redact(text: str, names: tuple[str, ...]) -> str:
    for n in names:
        text = f"regexp_replace({text}, {sql_pattern(by_name(n))}, '[REDACTED_{n.upper()}]', 'g')"
    return text


def pattern_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"), "text", COUNTED)


def pages_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "pages"), "html", tuple(by_name(n) for n in COMMON))


def conversations_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "conversations"), "text", tuple(by_name(n) for n in COMMON), "role")


def matches_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"), "text", tuple(by_name(n) for n in COMMON), "lang")


def matches_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"), "text", tuple(by_name(n) for n in COMMON), "source")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.detect(table(spark, sf_dir, "documents"), "text", F.lit("documents.body"), select(only=list(COMMON)), keep=("doc_id",)).drop("path")


def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.detect(table(spark, sf_dir, "documents"), "text", F.lit("documents.body"), keep=("doc_id",))


def context_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = select()
    docs = table(spark, sf_dir, "documents")
    sums = docs.agg(*[F.sum(F.size(detection.gated_matches(F.col("text"), d))).cast("long").alias(f"{d.category}_{d.name}") for d in policy.gated])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(d.name).alias("pattern_name"), F.lit(d.category).alias("category"), F.col(f"{d.category}_{d.name}").alias("n")) for d in policy.gated])))


def sql_gated() -> str:
    """Matches near a keyword: starts from the lengths of what stands between matches, then a window around each."""
    parts = []
    for d in select().gated:
        p = quoted(("(?i)" if d.ignore_case else "") + d.pattern)
        start = "(list_sum(sl[1:i]) + coalesce(list_sum(fl[1:i - 1]), 0))"
        near = f"lower(substring(text, CAST(greatest({start} - {d.window}, 0) + 1 AS BIGINT), CAST({start} + fl[i] + {d.window} - greatest({start} - {d.window}, 0) AS BIGINT)))"
        hit = " OR ".join(f"contains({near}, {quoted(w.lower())})" for w in d.keywords)
        lengths = f"SELECT text, list_transform(regexp_extract_all(text, {p}), lambda x: length(x)) AS fl, list_transform(regexp_split_to_array(text, {p}), lambda x: length(x)) AS sl FROM documents WHERE regexp_matches(text, {p})"
        parts.append(f"SELECT {quoted(d.name)} AS pattern_name, {quoted(d.category)} AS category, CAST(coalesce(sum(len(list_filter(range(1, len(fl) + 1), lambda i: {hit}))), 0) AS BIGINT) AS n FROM ({lengths})")
    return " UNION ALL ".join(parts)


def redact_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redaction.redact_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": "types"}, select(only=list(COMMON)))
    return out.select("doc_id", "text", F.array_join("types", ",").alias("types"))


def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redaction.redact_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": "types"})
    return out.select("doc_id", "text", F.array_join("types", ",").alias("types"))


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = redact_common(spark, sf_dir)
    twice = redaction.redact_columns(once.withColumnRenamed("text", "first").withColumn("text", F.col("first")), {"text": "again"}, select(only=list(COMMON)))
    return twice.agg(F.count("*").alias("rows"), F.count_if(F.col("text") != F.col("first")).alias("changed"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redact_lines(table(spark, sf_dir, "documents"), "text", ["doc_id"], select(only=["email", "phone_us"])).select("doc_id", "text", "lines_redacted")


def sensitive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("Full_Name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("long").cast("string").alias("salary"))
    return tables.sanitize_table(customer, "customer", replace(select(), detectors=select(only=["email"]).detectors)).rows


def table_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sanitize_table(table(spark, sf_dir, "orders"), "orders", profile=profile("ccpa")).evidence


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sanitize_table(table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "nickname"), "supplier").counts


def numbered_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.number_redactions(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", "s_suppkey")


def json_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit('{"user": "u'), F.col("user_id").cast("string"), F.lit('", "Auth_Code": '), F.col("event_id").cast("string"), F.lit(', "note": "mail u'), F.col("user_id").cast("string"), F.lit('@example.org"}'))
    out = carriers.redact_json(table(spark, sf_dir, "events").select("event_id", value.alias("doc")), "doc")
    return out.select("event_id", "redacted.text", F.size("redacted.keys").alias("keys_redacted"))


def key_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("key")).distinct()
    return words.select("key", carriers.key_is_sensitive(F.col("key")).alias("sensitive"))


def csv_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("n"), F.col("c_name").alias("Name"), F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@b.org")).alias("memo"))
    return carriers.redact_csv(customer, select(only=None))


def zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    value = F.when(F.col("c_custkey") % 7 == 0, "none").when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("CA "), F.lpad(key, 5, "9"))).otherwise(F.lpad(key, 5, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", truncate_zip(value).alias("zip3"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.col("o_orderkey") % 4
    value = F.when(form == 0, day).when(form == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(form == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("some day")
    return table(spark, sf_dir, "orders").select("o_orderkey", generalize_date(value).alias("year"))


def profile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = profile("all")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("service_date"), F.lpad(F.col("o_custkey").cast("string"), 5, "0").alias("Zip_Code"), F.col("o_orderstatus").alias("status"))
    return orders.select("o_orderkey", *[transform_value(c, F.col(c), by).alias(c) for c in ("service_date", "Zip_Code", "status")])


ACTIONS = (("generic_sanitize", "sensitive_column:email sensitive_column:zip pii_table:orders ssn phone_us"), ("exif_strip", ""), ("generic_sanitize", "ip_v4 npi sensitive_column:race sensitive_column:salary"))


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, t.split()) for a, t in ACTIONS], "action string, pii_types_found array<string>")


def coverage_query(mode: str) -> Query:
    return lambda spark, sf_dir: coverage.coverage(actions(spark), mode)


def sql_coverage(mode: str) -> str:
    got = {("action", a) for a, _ in ACTIONS} | {(("col" if t.startswith("sens") else "table" if t.startswith("pii") else "type"), t.split(":")[-1]) for _, ts in ACTIONS for t in ts.split()}
    rows, frameworks = [], coverage.FRAMEWORKS[mode]
    for framework in frameworks:
        for identifier, kinds in C.EVIDENCE[framework].items():
            rows += [f"({quoted(framework)}, {quoted(identifier)}, {quoted(kind)}, {quoted(name)})" for kind, names in kinds.items() for name in names]
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(got))
    open_ = "".join(f" UNION ALL SELECT {quoted(f)}, {quoted(g)}, false" for f in frameworks for g in coverage.OPEN_GAPS.get(f, ()))
    return f"WITH m(framework, identifier, kind, word) AS (VALUES {', '.join(rows)}), g(kind, word) AS (VALUES {values}) SELECT framework, identifier, bool_or(EXISTS (SELECT 1 FROM g WHERE (g.kind = m.kind AND g.word = m.word) OR (m.kind = 'prefix' AND g.kind = 'type' AND starts_with(g.word, m.word)))) AS covered FROM m GROUP BY framework, identifier{open_}"


def gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.gaps(coverage.coverage(actions(spark), "all"))


def device_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each event: directories of several kinds by the event's number."""
    n = F.col("event_id")
    roots = ("private/var/mobile/Library/SMS/", "System/Library/", "private/var/mobile/Library/Preferences/", "private/var/mobile/Media/", "opt/", "private/var/mobile/Library/CoreDuet/Knowledge/", "var/mobile/pics/")
    names = ("sms.db", "a.plist", "IMG.JPG", "knowledgeC.db", "clip.mov", "notes.txt", "history.db", "com.apple.wifi.plist", ".bash_history", "x.json", "y.csv")
    root = F.element_at(F.array(*[F.lit(r) for r in roots]), (n % len(roots) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(r) for r in names]), (n % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(root, n.cast("string"), F.lit("/"), name).alias("path"), (n * 7919 % 100_000_000).alias("length"))


SQL_PATHS = """SELECT event_id, list_extract(['private/var/mobile/Library/SMS/', 'System/Library/', 'private/var/mobile/Library/Preferences/', 'private/var/mobile/Media/', 'opt/', 'private/var/mobile/Library/CoreDuet/Knowledge/', 'var/mobile/pics/'], CAST(event_id % 7 + 1 AS INTEGER)) || event_id || '/' || list_extract(['sms.db', 'a.plist', 'IMG.JPG', 'knowledgeC.db', 'clip.mov', 'notes.txt', 'history.db', 'com.apple.wifi.plist', '.bash_history', 'x.json', 'y.csv'], CAST(event_id % 11 + 1 AS INTEGER)) AS path, event_id * 7919 % 100000000 AS length FROM events"""


def sql_classified() -> str:
    low = lambda p: quoted(p.lower().lstrip("/"))
    cases = [(f"starts_with(low, {low(p)})", "PRESERVE", f"system: {p}") for p in C.PRESERVED_PREFIXES]
    cases += [(f"suffix(low, {quoted(p.lower())})", "SELECTIVE_DB", f"mixed db: {n}") for p, n in C.MIXED_DATABASES]
    cases += [(f"contains(low, {low(p)})", "DELETE", f"personal data: {p}") for p in C.PERSONAL_DIRECTORIES]
    cases += [(f"name = {quoted(p.lower())}", "DELETE", f"personal database: {p}") for p in C.PERSONAL_FILES]
    cases += [(f"name = {quoted(p.lower())}", "DELETE", f"wifi credentials: {p}") for p in C.NETWORK_FILES]
    cases += [(f"suffix(low, {quoted(s)}) AND contains(low, {quoted(C.MEDIA_SCOPE)})", "EXIF_STRIP" if s in C.STRIPPED_SUFFIXES else "DELETE", f"media in {C.MEDIA_SCOPE}") for s in C.MEDIA_SUFFIXES]
    cases += [(f"suffix(low, '.plist') AND contains(low, {low(p)})", "PLIST_SANITIZE", f"plist: {p}") for p in C.PLIST_DIRECTORIES]
    pick = lambda j, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {quoted(c[j])}" for c in cases) + f" ELSE {quoted(other)} END"
    return f"SELECT path, length AS size, {pick(1, 'PRESERVE')} AS action, {pick(2, 'unclassified (default preserve)')} AS reason FROM (SELECT path, length, lower(path) AS low, lower(list_extract(string_split(path, '/'), -1)) AS name FROM ({SQL_PATHS}))"


def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.scan(device_paths(spark, sf_dir))


def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.histogram(classify_paths(spark, sf_dir))


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.summary(classify_paths(spark, sf_dir))


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = classify_paths(spark, sf_dir).select(F.lower("action").alias("action"), F.when(F.col("action") == "SELECTIVE_DB", F.sha2("path", 256)).alias("hash_before"))
    return manifest.manifest_summary(acted)


def artifact_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.artifact_actions(device_paths(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


def size_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, skipped = paths.size_partition(device_paths(spark, sf_dir))
    return fits.groupBy("kind").agg(F.count("*").alias("n")).unionByName(skipped.groupBy(F.col("action").alias("kind")).agg(F.count("*").alias("n")))


PLATFORM_NAMES = tuple(sorted({n for _, names in C.SIGNATURES for n in names} | {n for names in C.EMPTIED_TABLES.values() for n in names}))


def platform_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases of tables that the events name: each of some names that tell or fill a kind of database."""
    n = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in PLATFORM_NAMES]), ((n * 31 + F.col("user_id")) % len(PLATFORM_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("db"), (n % 199).cast("string")).alias("db"), name.alias("table_name")).distinct()


def sql_platforms() -> str:
    """Kinds by counting the names of each that a database has."""
    parts = ", ".join(f"({i}, {quoted(kind)}, {quoted(n.lower())}, {len(names)})" for i, (kind, names) in enumerate(C.SIGNATURES) for n in names)
    names = ", ".join(map(quoted, PLATFORM_NAMES))
    return f"""dbs AS (SELECT DISTINCT 'db' || event_id % 199 AS db, list_extract([{names}], CAST((event_id * 31 + user_id) % {len(PLATFORM_NAMES)} + 1 AS INTEGER)) AS table_name FROM events),
parts(position, db_type, low, needed) AS (VALUES {parts}),
whole AS (SELECT db, position, db_type FROM dbs JOIN parts ON lower(table_name) = low GROUP BY db, position, db_type, needed HAVING count(DISTINCT low) = needed),
kinds AS (SELECT d.db, arg_min(w.db_type, w.position) AS db_type FROM (SELECT DISTINCT db FROM dbs) d LEFT JOIN whole w ON w.db = d.db GROUP BY d.db)"""


def platform_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platforms.detect_platforms(platform_tables(spark, sf_dir))


def platform_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platforms.emptied_tables(platform_tables(spark, sf_dir))


KNOWN_STREAMS = ("/app/Safari", "/siri/ui", "/app/inFocus", "x/Contacts", "/messaging/out", "/display")
RULE_STATEMENTS = (*dict(C.DATABASE_RULES)["CoreDuet/Knowledge/knowledgeC.db"], "DELETE FROM nowhere", "UPDATE ZOBJECT SET ZSTREAMNAME = concat(ZSTREAMNAME, '\\s') WHERE user_id > 50 OR ZSTREAMNAME LIKE '/DISPLAY'")


def ruled(spark: SparkSession, sf_dir: str) -> rules.Ruled:
    n = F.col("event_id")
    stream = F.element_at(F.array(*[F.lit(x) for x in KNOWN_STREAMS]), (n % len(KNOWN_STREAMS) + 1).cast("int"))
    value = F.when(n % 4 == 0, F.concat(F.lit("com.apple."), n.cast("string"))).when(n % 4 < 3, F.concat(F.lit("org.x"), n.cast("string")))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", stream.alias("ZSTREAMNAME"), value.alias("ZVALUESTRING"))
    return rules.apply_rules({"ZOBJECT": events}, RULE_STATEMENTS, spark)


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled(spark, sf_dir).tables["ZOBJECT"].drop("user_id")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ruled(spark, sf_dir)
    return out.counts.unionByName(out.errors.select(F.lit(None).cast("int").alias("position"), "table_name", "operation", F.lit(None).cast("long").alias("rows_affected")))


def sql_ruled() -> str:
    plain = "v IS NOT NULL AND NOT starts_with(v, 'com.apple.')"
    stream = f"list_extract([{', '.join(map(quoted, KNOWN_STREAMS))}], CAST(event_id % {len(KNOWN_STREAMS)} + 1 AS INTEGER))"
    return f"(SELECT event_id, user_id, s, CASE WHEN {plain} THEN '[REDACTED]' ELSE v END AS v, {plain} AS put FROM (SELECT event_id, user_id, {stream} AS s, CASE event_id % 4 WHEN 0 THEN 'com.apple.' || event_id WHEN 3 THEN NULL ELSE 'org.x' || event_id END AS v FROM events))"


CONTAINED = ("Documents/a", "Library/Caches/b", "Documents/c", "tmp/d", "e", "f/g", "Library/org.coolstar.sileo.", "h", "i", "j", "k/Newterm/", "l", "m", "n/o", "p", "q", "r", "s", "t")


def app_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in directories of apps, by the events: some hold the name of an app that is kept."""
    n = F.col("event_id")
    inside = F.element_at(F.array(*[F.lit(x) for x in CONTAINED]), (n % len(CONTAINED) + 1).cast("int"))
    root = F.when(n % 9 == 0, "private/var/mobile/x/").otherwise(C.APP_CONTAINERS + "/")
    return paths.container_actions(table(spark, sf_dir, "events").select(F.concat(root, F.lit("A"), (F.col("user_id") * 100 + n % 100).cast("string"), F.lit("/"), inside, n.cast("string")).alias("path")))


def times_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.times_normalized(device_paths(spark, sf_dir), "2001-09-09")


def os_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each supplier; every third one's system file is no property list, every fifth has none."""
    k = F.col("s_suppkey")
    form = F.concat(F.lit('<?xml version="1.0"?><plist version="1.0"><dict><key>ProductVersion</key><string>'), k.cast("string"), F.lit(".1</string></dict></plist>"))
    path = F.when(k % 5 == 0, "System/x.plist").otherwise(C.VERSION_FILE)
    return files.os_version(table(spark, sf_dir, "supplier").select(k, path.alias("path"), F.encode(F.when(k % 3 == 0, "broken").otherwise(form), "UTF-8").alias("content")), ("s_suppkey",))


def integrity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that keep their rows, lose some, lose a column, and were to lose all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    some = orders.where("o_orderkey % 3 > 0")
    checks = [(orders, orders, "same", False), (orders, some, "fewer", False), (orders, orders.drop("o_orderstatus"), "narrow", False), (orders, some, "emptied", True), (orders, orders.limit(0), "empty", True)]
    return reduce(DataFrame.unionByName, [verification.integrity(*c) for c in checks])


def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("hash_before"))
    return redaction.redact_columns(before, {"text": "types"}, select(only=["email"])).select("doc_id", "hash_before", F.sha2("text", 256).alias("hash_after"))


def verify_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = select(only=list(COMMON))
    return verification.verify_column(redact_common(spark, sf_dir), "text", "documents.body", policy).verdict


def verify_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.verify_column(table(spark, sf_dir, "documents"), "text", "documents.body", select(only=list(COMMON))).verdict.select("passed", "total_findings")


def incomplete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = device_paths(spark, sf_dir).withColumn("text", F.when(F.col("event_id") % 5 > 0, "plain"))
    return verification.scan_files(files)[1].groupBy("check", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def scan_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumn("memo", F.concat(F.lit("mail u"), F.col("c_custkey").cast("string"), F.lit("@example.org")))
    return verification.scan_table(df, "customer", select(only=["phone_us", "email", "gps_coord"])).groupBy("path", "pattern_name").agg(F.count("*").alias("n"))


def scan_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in binary columns of both encodings and in nested ones: findings by column, and columns that no check reads."""
    docs = table(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("u8"), F.encode("text", "UTF-16").alias("u16"), F.array("text", "lang").alias("list"), F.create_map(F.lit("k"), F.col("text")).alias("map"), F.struct("text", F.array(F.struct("text")).alias("more")).alias("nested"), F.array(F.encode("text", "UTF-8")).alias("dark"))
    found = verification.scan_table(docs, "d", select(only=list(COMMON))).groupBy("path", "pattern_name").agg(F.count("*").alias("n"))
    return found.unionByName(verification.unscanned_columns(docs, "d").select("path", F.lit("incomplete").alias("pattern_name"), F.lit(1).cast("long").alias("n")))


def jailbreak_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees by the event's number, some with a sign: what each is told to be."""
    n = F.col("event_id")
    signs = F.element_at(F.array(*[F.lit(x) for x in JAILBREAK_PATHS]), (n % len(JAILBREAK_PATHS) + 1).cast("int"))
    events = table(spark, sf_dir, "events").select((n % 11).alias("tree"), F.when(n % 11 < 8, signs).otherwise(F.lit("private/var/mobile/x")).alias("path"))
    out = [paths.jailbreak(events.where(F.col("tree") == i)).select(F.lit(i).cast("long").alias("tree"), "detected", "type") for i in range(11)]
    return reduce(DataFrame.unionByName, out)


JAILBREAK_PATHS = ("private/var/jb/usr/bin/sh", "private/var/mobile/Media/a.jpg", "System/Library/x")


def cache_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in CACHE_ROOTS]), (n % len(CACHE_ROOTS) + 1).cast("int")), n.cast("string"), F.element_at(F.array(*[F.lit(x) for x in CACHE_NAMES]), (n % len(CACHE_NAMES) + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", artifacts.artifact_kind(path).alias("kind"))


CACHE_ROOTS = ("a/Library/Caches/", "x/Code Cache/", "logs/CrashReporter/", "db/store.leveldb/", "plain/", "u/IndexedDB/")
CACHE_NAMES = (".txt", ".swp", ".ips", "/pagefile.sys", ".evtx")


def files_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths outside of deleted directories whose plist was not yet redacted, and companions of databases."""
    files = device_paths(spark, sf_dir).select("path")
    acted = files.where("path LIKE '%.plist' AND length(path) % 2 = 0").select(F.lit("plist_sanitize").alias("action"), "path", F.lit(None).cast("string").alias("error"))
    gone = spark.createDataFrame([("private/var/mobile/Library/SMS",), ("opt/",)], "path string")
    left = paths.not_done(paths.outside(files, gone), acted, "plist_sanitize").select(F.lit("left").alias("action"), "path")
    beside = files.where("path LIKE '%.db'").select(F.concat("path", F.lit("-wal")).alias("path")).unionByName(files.where("path LIKE '%.txt'").select(F.concat("path", F.lit("-shm")).alias("path")))
    real = files.where("path LIKE '%.db'").unionByName(beside)
    return left.unionByName(paths.companion_actions(real)).groupBy("action").agg(F.count("*").alias("n"))


def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("all", len(select().detectors)), ("only financial", len(select(only=["financial"]).detectors)), ("only email", len(select(only=["email"]).detectors)), ("skip crypto and email", len(select(skip=["crypto", "email"]).detectors)), ("listed", len(listing()))]
    return spark.createDataFrame(rows, "selection string, detectors long")


def stream_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, redacted into new files and read back."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/veilspark-streams") + f"/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "documents").select("doc_id", "text")
    stream = streaming.read_stream(spark, f"{sf_dir}/documents.parque[t]", source.schema)  # a pattern: a stream takes no single file
    streaming.write_redacted(stream, "text", f"{base}/out", f"{base}/state", select(only=list(COMMON))).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "text")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f.__name__: f for f in (
        pattern_histogram, pages_histogram, conversations_histogram, matches_by_lang, matches_by_source, findings, findings_all, context_matches, redact_common, redact_all, second_pass,
        log_lines, sensitive_columns, table_evidence, table_counts, numbered_redaction, json_redaction, key_predicate, csv_policy, zips, dates, profile_values, gap_list, classify_paths,
        action_histogram, scan_summary, manifest_summary, artifact_histogram, size_partition, platform_detect, platform_emptied, document_hashes, verify_redacted, verify_raw, incomplete_files, scan_customer, scan_nested, jailbreak_type, cache_kinds, files_left,
        selectors, stream_redaction, rule_rows, rule_counts, app_containers, times_normalized, os_versions, integrity_rows,
    )}
    found |= {f"suppress_{n}": suppression_query(n) for n in ("ip_v4", "credit_card", "swift_bic", "phone_us")}
    return found | {f"coverage_{m}": coverage_query(m) for m in coverage.FRAMEWORKS}


def oracle_sql() -> dict[str, str]:
    common = tuple(by_name(n) for n in COMMON)
    digits = "regexp_replace(match_text, '[^0-9]', '', 'g')"
    octet = lambda i: f"CAST(list_extract(string_split(match_text, '.'), {i}) AS INTEGER)"
    most = "greatest(" + ", ".join(f"length({digits}) - length(replace({digits}, '{c}', ''))" for c in "0123456789") + ")"
    lines = "SELECT doc_id, line, no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)"
    keep = {
        "imsi": "false", "email": "false", "phone_us": f"length({digits}) >= 10 AND {most} >= 7",
        "credit_card": f"{digits} IN ({', '.join(map(quoted, C.TEST_CARDS))}) OR len(list_distinct(string_split({digits}, ''))) = 1",
    }
    found = " UNION ALL ".join(f"SELECT doc_id, {quoted(n)} AS pattern_name, match_text, CAST(no AS INTEGER) AS line_number FROM (SELECT doc_id, no, unnest({sql_found(by_name(n), 'line')}) AS match_text FROM ({lines})) WHERE NOT coalesce({keep[n]}, false)" for n in COMMON)
    redacted = sql_redact("text", COMMON)
    fired, text = [], "text"
    for n in COMMON:
        fired.append(f"CASE WHEN regexp_matches({text}, {sql_pattern(by_name(n))}) THEN {quoted(n)} END")
        text = sql_redact(text, (n,))
    out = {
        "pattern_histogram": sql_histogram("documents", "text", COUNTED),
        "pages_histogram": sql_histogram("pages", "html", common),
        "conversations_histogram": sql_histogram("conversations", "text", common, "role"),
        "matches_by_lang": sql_histogram("documents", "text", common, "lang"),
        "matches_by_source": sql_histogram("documents", "text", common, "source"),
        "findings": found,
        "context_matches": sql_gated(),
        "redact_common": f"SELECT doc_id, {redacted} AS text, concat_ws(',', {', '.join(fired)}) AS types FROM documents",
        "second_pass": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM documents",
        "log_lines": f"SELECT doc_id, string_agg({sql_redact('line', ('email', 'phone_us'))}, chr(10) ORDER BY no) AS text, CAST(count(*) FILTER (WHERE {sql_redact('line', ('email', 'phone_us'))} <> line) AS INTEGER) AS lines_redacted FROM ({lines}) GROUP BY doc_id",
        "sensitive_columns": "SELECT c_custkey::VARCHAR AS id, '[REDACTED]' AS Full_Name, c_mktsegment AS segment, '[REDACTED]' AS salary FROM customer",
        "table_evidence": "SELECT 'pii_table:orders' AS evidence FROM orders HAVING count(*) > 0",
        "table_counts": "SELECT unnest(['s_suppkey', 's_nationkey', 's_acctbal', 'nickname']) AS column_name, unnest([0, 0, 0, (SELECT count(*) FROM supplier WHERE s_name <> '')]) AS events",
        "numbered_redaction": "SELECT s_suppkey, '[REDACTED_' || (row_number() OVER (ORDER BY s_suppkey) - 1) || ']' AS s_name FROM supplier",
        "json_redaction": "SELECT event_id, '{' || chr(10) || '  \"user\": \"u' || user_id || '\",' || chr(10) || '  \"Auth_Code\": 0,' || chr(10) || '  \"note\": \"mail [REDACTED_EMAIL]\"' || chr(10) || '}' AS text, CAST(CASE WHEN event_id = 0 THEN 1 ELSE 2 END AS INTEGER) AS keys_redacted FROM events",
        "key_predicate": f"SELECT DISTINCT key, key NOT IN ({', '.join(map(quoted, C.SAFE_KEYS))}) AND (key IN ({', '.join(quoted(k) for k in sorted(select().keys))}) OR regexp_matches(key, {quoted('|'.join(C.SENSITIVE_FRAGMENTS))})) AS sensitive FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS key FROM documents)",
        "csv_policy": "SELECT c_custkey::VARCHAR AS n, '[REDACTED]' AS Name, '[REDACTED_EMAIL]' AS memo, CAST(2 AS INTEGER) AS cells_redacted FROM customer",
        "zips": f"SELECT c_custkey, CASE WHEN p = '' OR p IN ({', '.join(map(quoted, C.RESTRICTED_ZIP3))}) THEN '000' ELSE p END AS zip3 FROM (SELECT c_custkey, left(regexp_extract(CASE WHEN c_custkey % 7 = 0 THEN 'none' WHEN c_custkey % 7 = 1 THEN 'CA ' || lpad(c_custkey::VARCHAR, 5, '9') ELSE lpad(c_custkey::VARCHAR, 5, '0') END, '[0-9]{{3,}}'), 3) AS p FROM customer)",
        "dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '[REDACTED]' ELSE strftime(o_orderdate, '%Y') END AS year FROM orders",
        "profile_values": f"SELECT o_orderkey, strftime(o_orderdate, '%Y') AS service_date, CASE WHEN left(lpad(o_custkey::VARCHAR, 5, '0'), 3) IN ({', '.join(map(quoted, C.RESTRICTED_ZIP3))}) THEN '000' ELSE left(lpad(o_custkey::VARCHAR, 5, '0'), 3) END AS Zip_Code, o_orderstatus AS status FROM orders",
        "gap_list": f"SELECT identifier FROM ({sql_coverage('all')}) GROUP BY identifier HAVING NOT bool_or(covered)",
        "classify_paths": sql_classified(),
        "action_histogram": f"SELECT action, count(*) AS n FROM ({sql_classified()}) GROUP BY action",
        "scan_summary": f"SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size, count(*) FILTER (WHERE action = 'DELETE') AS delete_count, count(*) FILTER (WHERE action = 'PRESERVE') AS preserve_count, CAST(sum(size) FILTER (WHERE action = 'DELETE') AS BIGINT) AS delete_size, bool_or(starts_with(reason, 'system:')) AS acted_on FROM ({sql_classified()})",
        "manifest_summary": f"SELECT count(*) FILTER (WHERE action = 'DELETE') AS files_deleted, count(*) FILTER (WHERE action = 'SELECTIVE_DB') AS databases_sanitized, count(*) FILTER (WHERE action = 'PLIST_SANITIZE') AS plists_sanitized, count(*) FILTER (WHERE action = 'EXIF_STRIP') AS exif_stripped, count(*) FILTER (WHERE action = 'SELECTIVE_DB') AS files_with_hashes, count(*) AS actions FROM ({sql_classified()})",
        "artifact_histogram": f"SELECT 'delete_artifact' AS action, count(*) AS n FROM ({SQL_PATHS}) WHERE suffix(path, '/.bash_history')",
        "size_partition": f"SELECT CASE WHEN kind = 'history' OR length <= CASE kind WHEN 'log' THEN 10485760 ELSE 52428800 END THEN kind ELSE 'text_sanitize_skipped' END AS kind, count(*) AS n FROM (SELECT length, CASE WHEN suffix(path, '.bash_history') THEN 'history' WHEN suffix(path, '.json') THEN 'json' WHEN suffix(path, '.txt') THEN 'log' WHEN suffix(path, '.csv') THEN 'csv' END AS kind FROM ({SQL_PATHS})) WHERE kind IS NOT NULL GROUP BY 1",
        "platform_detect": f"WITH {sql_platforms()} SELECT db, db_type FROM kinds",
        "platform_emptied": f"WITH {sql_platforms()}, gone(db_type, low) AS (VALUES {', '.join(f'({quoted(k)}, {quoted(n.lower())})' for k, names in C.EMPTIED_TABLES.items() for n in names)}) SELECT dbs.db, kinds.db_type, dbs.table_name FROM dbs JOIN kinds ON dbs.db = kinds.db WHERE EXISTS (SELECT 1 FROM gone WHERE gone.db_type = kinds.db_type AND gone.low = lower(dbs.table_name))",
        "rule_rows": rf"SELECT event_id, CASE WHEN user_id > 50 OR s = '/display' THEN s || '\s' ELSE s END AS ZSTREAMNAME, v AS ZVALUESTRING FROM {sql_ruled()} WHERE s IN ('/app/inFocus', '/display')",
        "rule_counts": f"SELECT CAST(p AS INTEGER) AS position, 'ZOBJECT' AS table_name, o AS operation, n AS rows_affected FROM (SELECT unnest([0, 1, 2, 3, 4, 6]) AS p, unnest(['update', 'delete', 'delete', 'delete', 'delete', 'update']) AS o, unnest([count(*) FILTER (WHERE put), count(*) FILTER (WHERE s = '/app/Safari'), count(*) FILTER (WHERE s = '/siri/ui'), count(*) FILTER (WHERE s = '/messaging/out'), count(*) FILTER (WHERE s = 'x/Contacts'), count(*) FILTER (WHERE s = '/display' OR (s = '/app/inFocus' AND user_id > 50))]) AS n FROM {sql_ruled()}) UNION ALL SELECT NULL, 'nowhere', 'delete', NULL",
        "app_containers": f"SELECT CASE WHEN k THEN 'preserve' ELSE 'delete_directory' END AS action, {quoted(C.APP_CONTAINERS + '/A')} || app AS path, CASE WHEN k THEN 'jailbreak app' ELSE 'third-party app' END AS reason FROM (SELECT user_id * 100 + event_id % 100 AS app, bool_or(event_id % {len(CONTAINED)} IN (6, 10)) AS k FROM events WHERE event_id % 9 > 0 GROUP BY 1)",
        "times_normalized": "SELECT 'normalize_timestamps' AS action, '2001-09-09' AS epoch, CAST(epoch(TIMESTAMP '2001-09-09 00:00:00') AS BIGINT) AS epoch_ts, count(*) + 1 AS files_normalized FROM events",
        "os_versions": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 'unknown' ELSE s_suppkey || '.1' END AS version FROM supplier",
        "integrity_rows": "WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS b FROM orders) SELECT 'integrity' AS \"check\", unnest(['fewer', 'emptied', 'narrow']) AS path, unnest(['rows: ' || a || ' before, ' || b || ' after', 'rows: ' || a || ' before, ' || b || ' after', 'columns differ']) AS reason FROM n",
        "document_hashes": f"SELECT doc_id, sha256(text) AS hash_before, sha256({sql_redact('text', ('email',))}) AS hash_after FROM documents",
        "verify_redacted": "SELECT true AS passed, true AS performed, CAST(NULL AS VARCHAR) AS scope, CAST(0 AS BIGINT) AS total_findings, CAST(0 AS BIGINT) AS incomplete",
        "verify_raw": f"SELECT count(*) = 0 AS passed, count(*) AS total_findings FROM ({found})",
        "incomplete_files": f"SELECT 'text_scan' AS \"check\", CASE WHEN length > 10485760 THEN 'over the scan limit' ELSE 'unreadable' END AS reason, count(*) AS n FROM ({SQL_PATHS}) WHERE regexp_matches(path, '\\.(txt|plist|json|csv)$') AND NOT contains(path, 'System/Library/') AND (length > 10485760 OR event_id % 5 = 0) GROUP BY 2",
        "scan_nested": f"WITH f AS (SELECT pattern_name, count(*) AS n FROM ({found}) GROUP BY 1) SELECT path, pattern_name, CAST(n * times AS BIGINT) AS n FROM f, (VALUES ('d.u8', 1), ('d.u16', 1), ('d.list', 1), ('d.map', 1), ('d.nested', 2)) p(path, times) UNION ALL SELECT 'd.dark', 'incomplete', 1",
        "scan_customer": "SELECT 'customer.memo' AS path, 'email' AS pattern_name, count(*) AS n FROM customer",
        "jailbreak_type": f"SELECT tree, bool_or(starts_with(path, 'private/var/jb/')) AS detected, CASE WHEN bool_or(starts_with(path, 'private/var/jb/')) THEN 'unknown' ELSE '' END AS type FROM (SELECT event_id % 11 AS tree, CASE WHEN event_id % 11 < 8 THEN list_extract([{', '.join(map(quoted, JAILBREAK_PATHS))}], CAST(event_id % 3 + 1 AS INTEGER)) ELSE 'x' END AS path FROM events) GROUP BY tree",
        "cache_kinds": f"SELECT event_id, CASE WHEN contains(p, '.leveldb/') THEN 'leveldb' WHEN contains(p, 'Caches/') OR contains(p, 'Code Cache/') THEN 'cache' WHEN suffix(p, '.swp') OR suffix(p, '/pagefile.sys') THEN 'swap' WHEN contains(p, 'CrashReporter/') OR suffix(p, '.ips') THEN 'crash' WHEN contains(p, 'IndexedDB/') OR suffix(p, '.evtx') THEN 'artifact' END AS kind FROM (SELECT event_id, list_extract([{', '.join(map(quoted, CACHE_ROOTS))}], CAST(event_id % 6 + 1 AS INTEGER)) || event_id || list_extract([{', '.join(map(quoted, CACHE_NAMES))}], CAST(event_id % 5 + 1 AS INTEGER)) AS p FROM events)",
        "files_left": f"WITH p AS (SELECT path FROM ({SQL_PATHS})) SELECT 'left' AS action, count(*) AS n FROM p WHERE NOT (starts_with(path, 'private/var/mobile/Library/SMS/') OR starts_with(path, 'opt/')) AND NOT (suffix(path, '.plist') AND length(path) % 2 = 0) UNION ALL SELECT 'delete_companion', count(*) FROM p WHERE suffix(path, '.db') UNION ALL SELECT 'delete_orphan', count(*) FROM p WHERE suffix(path, '.txt')",
        "selectors": "SELECT * FROM (VALUES ('all', 68), ('only financial', 16), ('only email', 1), ('skip crypto and email', 60), ('listed', 68)) t(selection, detectors)",
        "stream_redaction": f"SELECT doc_id, {redacted} AS text FROM documents",
        "suppress_ip_v4": sql_suppression("ip_v4", f"{octet(1)} IN (17, 10) OR ({octet(1)} = 172 AND {octet(2)} BETWEEN 16 AND 31) OR ({octet(1)} = 192 AND {octet(2)} = 168) OR length(match_text) = 7"),
        "suppress_credit_card": sql_suppression("credit_card", keep["credit_card"]),
        "suppress_swift_bic": sql_suppression("swift_bic", "regexp_matches(match_text, '^[A-Z]{8}$') OR len(list_distinct(string_split(match_text, ''))) <= 2"),
        "suppress_phone_us": sql_suppression("phone_us", keep["phone_us"]),
    }
    return out | {f"coverage_{m}": sql_coverage(m) for m in coverage.FRAMEWORKS}
