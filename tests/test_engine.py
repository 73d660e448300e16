"""Operators of the engine on small inputs."""

from __future__ import annotations

import json
import plistlib
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.columns import named
from veilspark.functions.policy import select
from veilspark.functions.pytext import redact_text
from veilspark.functions.safe_harbor import generalize_date, profile, truncate_zip
from veilspark.functions.suppression import suppressed
from veilspark.operators import carriers, coverage, detection, paths, platforms, redaction, rules, tables, verification
from veilspark.plans import manifest
from veilspark.sources import files, sqlite


def values(df, column):
    return [r[column] for r in df.collect()]


def test_redaction_agrees_with_python(spark):
    words = ["mail jo@ex.org", "driver D1234567", "sol abcdefghijkmnopqrstuvwxyzABCDEFGH", "415-555-2671", "password: x y", "bank 123456789", "DOB 1990-01-02", "é", "DEUTDEFF500", "npi 1234567890", "AKIA" + "A" * 16, "plain", "4111 1111 1111 1111", "using 123-456-789"]
    texts = [" ".join(words[(i * k + j) % len(words)] for j in range(5)) + "\n" * (i % 3) for i in range(14) for k in (1, 3, 5)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for policy in (select(), select(only=["context" if False else "us_passport", "email"]), select(skip=["financial", "sin_tfn"])):
        for r in redaction.redact_columns(df, {"text": "types"}, policy).collect():
            expected = (None, []) if texts[r.i] is None else redact_text(texts[r.i], policy)
            assert (r.text, list(r.types)) == (expected[0], expected[1])


def test_findings_have_lines_and_context(spark):
    df = spark.createDataFrame([(1, "one\r\nmail a@b.org\nDOB: 1990-01-02\nSSN 123-45-6789"), (2, None), (3, "")], "id int, text string")
    found = {(r.pattern_name, r.line_number) for r in detection.detect(df, "text", F.lit("notes.body"), keep=("id",)).collect()}
    assert {("email", 2), ("date_of_birth", 3), ("ssn", 4)} <= found


SUPPRESSED = [
    ("usr/lib/x", "email", "a@b.org", True), ("a.body", "email", "a@b.org", False), ("a.body", "gps_coord", "181.1234", True), ("a.body", "gps_coord", "0.0000", True),
    ("a.body", "gps_coord", "-0.1278", False), ("a.body", "gps_coord", "07.6100", True), ("x.plist", "gps_coord", "11.5600", True), ("x.plist", "gps_coord", "11.56494140625", True),
    ("x.plist", "gps_coord", "0.12781", False), ("x.json", "gps_coord", "11.5600", False), ("t.external_mod_tag", "gps_coord", "12.34567", True), ("db.Z_PK", "ssn", "123456789", True),
    ("a.json", "ssn", "123456789", False), ("a.body", "ip_v4", "17.1.2.3", True), ("a.body", "ip_v4", "10.11.2.3", True), ("a.body", "ip_v4", "172.16.0.1", True),
    ("a.body", "ip_v4", "172.32.0.1", False), ("a.body", "ip_v4", "192.168.1.1", True), ("a.body", "ip_v4", "2.3.5.8", True), ("a.body", "ip_v4", "8.8.44.4", False),
    ("a.body", "phone_us", "3333333334", True), ("a.body", "phone_us", "4155552671", False), ("a.body", "credit_card", "4111 1111 1111 1111", True), ("a.body", "credit_card", "4012888888881881", False),
    ("v.c0", "password_kv", "pwd=x", True), ("a.body", "password_kv", "pwd=x", False), ("a.body", "email", "[REDACTED_EMAIL]", True), ("t.url", "phone_us", "4155552671", True),
    ("t.URL", "phone_us", "4155552671", False), ("a.body", "vin", "1234567890abcdef1", True), ("a.body", "swift_bic", "ABCDEFGH", True), ("a.body", "swift_bic", "DEUTDEFF500", False),
    ("a.body", "ethereum_address", "0x" + "0" * 30 + "1" * 10, True), ("a.body", "bitcoin_address", "1" + "a" * 30, True), ("t.uuid", "bitcoin_address", "1" + "z" * 30, True),
    ("a.body", "cusip", "111111111", True), ("x.plist", "us_routing", "021000021", True), ("a.body", "us_routing", "021345678", False), ("a.body", "ripple", "rrrrrrrrrrrrrrrrrrrrrrrrrr", True),
    ("x.plist", "dea_number", "AB1234567", True), ("a.body", "url_credentials", "https://a:b@cdn-apple.com/", True),
]


def test_suppression(spark):
    df = spark.createDataFrame(SUPPRESSED, "path string, name string, found string, expected boolean")
    wrong = df.where(suppressed(F.col("path"), F.col("name"), F.col("found")) != F.col("expected")).collect()
    assert not wrong


def test_safe_harbor(spark):
    zips = [("94105", "941"), ("03601", "000"), ("CA 94105-1234", "941"), ("none", "000"), ("12", "000"), (None, None)]
    df = spark.createDataFrame(zips, "v string, e string")
    assert all(r.got == r.e for r in df.select("e", truncate_zip(F.col("v")).alias("got")).collect())
    days = [("2019-03-14", "2019"), ("03/14/2019", "2019"), ("March 15, 1985", "1985"), ("20190314", "2019"), ("03142019", "2019"), ("soon", "[REDACTED]"), ("12345678", "[REDACTED]"), (None, None)]
    df = spark.createDataFrame(days, "v string, e string")
    assert all(r.got == r.e for r in df.select("e", generalize_date(F.col("v")).alias("got")).collect())


def test_tables(spark):
    df = spark.createDataFrame([(1, "Jo", "x a@b.org", "94105"), (2, "", "plain", None), (3, None, None, "1")], "id int, Name string, note string, zip string")
    got = tables.sanitize_table(df, "people")
    assert [tuple(r) for r in got.rows.orderBy("id").collect()] == [("1", "[REDACTED]", "x [REDACTED_EMAIL]", "[REDACTED]"), ("2", "", "plain", None), ("3", None, None, "[REDACTED]")]
    assert set(values(got.evidence, "evidence")) == {"sensitive_column:name", "sensitive_column:zip", "email"}
    assert {r.column_name: r.events for r in got.counts.collect()} == {"id": 0, "note": 1, "Name": 1, "zip": 2}
    emptied = tables.sanitize_table(df, "Contacts")
    assert emptied.rows.isEmpty() and values(emptied.evidence, "evidence") == ["pii_table:Contacts"]
    hipaa = tables.sanitize_table(df, "people", profile=profile("hipaa"))
    assert values(hipaa.rows.orderBy("id"), "zip") == ["941", None, "000"]
    numbered = tables.number_redactions(spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "b")], "id int, v string"), "v", "id", groups=2)
    assert values(numbered.orderBy("id"), "v") == ["[REDACTED_0]", None, "", "[REDACTED_2]"]


def test_carriers(spark):
    doc = {"username": "u", "pin_token": 5, "version": "1.2.3", "empty": "", "nested": {"note": "a@b.org", "list": ["c@d.org", 1]}, "auth": {"x": "plain"}, "flag_secret": True, "n": 3}
    rows = carriers.redact_json(spark.createDataFrame([(json.dumps(doc),), ("{broken",), (None,)], "doc string"), "doc").collect()
    out = json.loads(rows[0].redacted.text)
    assert out["username"] == "[REDACTED]" and out["pin_token"] == 0 and out["version"] == "1.2.3" and out["n"] == 3 and out["flag_secret"] == 0
    assert out["nested"] == {"note": "[REDACTED_EMAIL]", "list": ["[REDACTED_EMAIL]", 1]} and out["auth"] == {"x": "plain"} and len(rows[0].redacted["keys"]) == 5
    assert rows[1].redacted.error and rows[1].redacted.text == "{broken" and rows[2].redacted.text is None
    cells = carriers.redact_csv(spark.createDataFrame([("1", "Jo", "a@b.org"), ("2", " ", "x")], ["id", " Name", "memo"])).collect()
    assert [tuple(r) for r in cells] == [("1", "[REDACTED]", "[REDACTED_EMAIL]", 2), ("2", " ", "x", 0)]
    tree = {"userEmail": "x", "BundleVersion": "1", "aa:bb:cc:dd:ee:ff": {"n": 1}, "mobile": 4155552671, "zlatitude": 37.77, "list": [12.34567, "a@b.org"], "nested": plistlib.dumps({"m": "c@d.org"}), "when": True}
    plists = [("a.plist", plistlib.dumps(tree)), ("data_ark.plist", plistlib.dumps({"a": "s", "n": 3, "t": True}, fmt=plistlib.FMT_BINARY)), ("x.plist", b"no")]
    got = carriers.redact_plists(spark.createDataFrame(plists, "name string, content binary"), "name", "content").collect()
    first = plistlib.loads(bytes(got[0].redacted.content))
    assert first["userEmail"] == "[REDACTED]" and first["BundleVersion"] == "1" and "[REDACTED_MAC_ADDR]" in first and first["mobile"] == 0 and first["zlatitude"] == 0.0
    assert first["list"] == [0.0, "[REDACTED_EMAIL]"] and plistlib.loads(first["nested"])["m"] == "[REDACTED_EMAIL]" and first["when"] is True
    assert bytes(got[1].redacted.content).startswith(b"bplist") and plistlib.loads(bytes(got[1].redacted.content)) == {"a": "[REDACTED]", "n": 0, "t": True}
    assert got[2].redacted.error


def test_verification_fails_closed(spark):
    found = spark.createDataFrame([("a.txt", 10, "clean"), ("b.txt", 99 << 20, "big"), ("c.json", 5, None), ("manifest.json", 5, "a@b.org"), ("x.bin", 5, "a@b.org")], "path string, length long, text string")
    matches, incomplete = verification.scan_files(found)
    assert matches.isEmpty() and sorted(values(incomplete, "path")) == ["b.txt", "c.json"]
    assert not verification.verify(matches, incomplete).verdict.first().passed
    assert verification.verify(matches).verdict.first().passed
    table = spark.createDataFrame([(1, "x 415-555-2671", "a@b.org")], "id int, url string, body string")
    assert {(r.path, r.pattern_name) for r in verification.scan_table(table, "t", select(only=["email", "phone_us"])).collect()} == {("t.body", "email")}


def test_coverage(spark):
    acts = spark.createDataFrame([("generic_sanitize", ["sensitive_column:mrn", "phone_intl", "pii_table:orders"], None), ("exif_strip", [], "no tool")], "action string, pii_types_found array<string>, error string")
    report = coverage.coverage(acts, "all")
    covered = set(values(report.where("covered"), "identifier"))
    assert covered == {"medical_record_numbers", "phone_numbers", "identifiers", "commercial_information"}
    assert report.where("framework = 'hipaa'").count() == 18
    gap = values(coverage.gaps(report), "identifier")
    assert len(gap) == len(set(gap)) and "full_user_content_deletion" in gap and "identifiers" not in gap
    assert coverage.limitations(acts, "ccpa").count() == 2 and coverage.coverage(acts, "default").isEmpty()


def test_paths_and_platforms(spark):
    rules = [("System/Library/sms.db", "PRESERVE"), ("private/var/mobile/Library/SMS/sms.db", "DELETE"), ("x/CoreDuet/Knowledge/knowledgeC.db", "SELECTIVE_DB"), ("opt/KnowledgeC.db", "DELETE"), ("opt/com.apple.wifi.plist", "DELETE"), ("private/var/mobile/x/a.JPG", "EXIF_STRIP"), ("private/var/mobile/x/a.heif", "DELETE"), ("private/var/mobile/Library/Preferences/a.plist", "PLIST_SANITIZE"), ("opt/readme", "PRESERVE")]
    df = spark.createDataFrame([(p, 5, e) for p, e in rules], "path string, length long, expected string")
    assert all(r.action == r.expected for r in df.withColumn("action", paths.classify(F.col("path"))["action"]).collect())
    total = paths.summary(paths.scan(df)).first()
    assert total.total_files == 9 and total.delete_count == 4 and total.acted_on
    fits, skipped = paths.size_partition(spark.createDataFrame([("a.json", 1), ("b.log", 11 << 20), ("c.csv", None), (".zsh_history", None), ("d.bin", 1)], "path string, length long"))
    assert sorted(values(fits, "path")) == [".zsh_history", "a.json"] and sorted(values(skipped, "path")) == ["b.log", "c.csv"]
    assert paths.jailbreak(spark.createDataFrame([("private/preboot/x/Dopamine.app",)], "path string")).first().type == "dopamine"
    rows = [("a", "ZASSET"), ("b", "sms"), ("b", "threads"), ("c", "SMS"), ("c", "threads"), ("c", "canonical_addresses")]
    kinds = {r.db: r.db_type for r in platforms.detect_platforms(spark.createDataFrame(rows, "db string, table_name string")).collect()}
    assert kinds == {"a": "photos_ios", "b": None, "c": "android_sms"}
    know = spark.createDataFrame([("/app/Safari", "x"), ("/app", "com.apple.x"), ("/app", "org.y"), (None, None)], "ZSTREAMNAME string, ZVALUESTRING string")
    assert sorted(map(str, values(platforms.handle_table(know, "knowledgec", "ZOBJECT"), "ZVALUESTRING"))) == ["None", "[REDACTED]", "com.apple.x"]
    assert platforms.handle_table(spark.createDataFrame([(1.5, 2)], "ZLATITUDE double, other int"), "photos_ios", "ZASSET").first().ZLATITUDE == "[GPS_REMOVED]"


def test_sources_and_manifest(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("CREATE TABLE notes (id INTEGER, body TEXT, raw BLOB)")
    db.execute("INSERT INTO notes VALUES (1, 'mail a@b.org', ?)", ("c@d.org".encode("utf-16"),))
    db.commit()
    db.close()
    (tmp_path / "b.db").write_bytes(b"broken")
    (tmp_path / "t.txt").write_bytes(b"ok \xff a@b.org")
    found = files.files(spark, str(tmp_path))
    cells = sqlite.sqlite_cells(found.where("path LIKE '%.db'"))
    assert cells.where("error IS NOT NULL").count() == 1
    assert set(values(detection.detect(cells, "value", F.col("column_name")).where("pattern_name = 'email'"), "path")) == {"body", "raw"}
    assert values(files.texts(found.where("path = 't.txt'")), "text") == ["ok  a@b.org"]
    files.write_new(cells, str(tmp_path / "out"))
    with pytest.raises(Exception):
        files.write_new(cells, str(tmp_path / "out"))
    acts = spark.createDataFrame([("delete", None), ("generic_sanitize", "h"), ("exif_strip", None)], "action string, hash_before string")
    line = json.loads(manifest.manifest(acts, paths.summary(spark.createDataFrame([("a", 1, "DELETE", "r")], "path string, size long, action string, reason string")), verification.verify(spark.createDataFrame([], verification.MATCH)).verdict).first().manifest)
    assert line["summary"]["files_deleted"] == 1 and line["summary"]["files_with_hashes"] == 1 and line["verification"]["passed"]


def test_names_of_catalog():
    assert sum(map(len, C.SENSITIVE_COLUMNS.values())) == 153 and len(set().union(*C.SENSITIVE_KEYS.values())) == 126 and len(set().union(*C.PERSONAL_TABLES.values())) == 87


def test_every_column_is_looked_into_or_reported(spark):
    """Binary values in both encodings, nested ones by their leaves, odd names; what isn't read keeps a table from passing."""
    mail = "a@b.org"
    rows = [(1, mail.encode(), ("x\u4e2d " + mail).encode("utf-16"), [mail, None], {"k": mail, mail: "v"}, (mail, [(mail,)]), True, mail), (2, b"\xff\xfe\xfd", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, u8 binary, u16 binary, list array<string>, map map<string,string>, nested struct<a:string,b:array<struct<c:string>>>, flag boolean, `a``b.c` string")
    policy = select(only=["email"])
    found = Counter(r.path for r in verification.scan_table(df, "t", policy).collect())
    assert found == {"t.u8": 1, "t.u16": 1, "t.list": 1, "t.map": 2, "t.nested": 2, "t.a`b.c": 1}
    assert verification.verify_table(df, "t", policy).verdict.first().passed is False
    clean = tables.sanitize_table(df.drop("list", "map", "nested"), "t", policy)
    done = {r.id: r for r in clean.rows.collect()}
    assert bytes(done["1"].u8) == b"[REDACTED_EMAIL]" and bytes(done["1"].u16).decode("utf-16") == "x\u4e2d [REDACTED_EMAIL]" and bytes(done["2"].u8) == b"\xff\xfe\xfd"
    assert verification.verify_table(clean.rows, "t", policy).verdict.first().passed
    odd = spark.createDataFrame([([b"x"],)], "raw array<binary>")
    assert [r.path for r in verification.unscanned_columns(odd, "t").collect()] == ["t.raw"] and not verification.verify_table(odd, "t", policy).verdict.first().passed


def test_lines_are_redacted_inside_the_row(spark):
    """Equal keys stay apart; ends of lines stay; null stays null."""
    df = spark.createDataFrame([(1, "a@b.org\r\nplain\n"), (1, "x\u2028c@d.org\rpassword: hunter22"), (2, None)], "k long, t string")
    out = redaction.redact_lines(df, "t", ["k"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.k, r.text, r.lines_redacted, list(r.types)) for r in out.collect()), key=str)
    assert got == sorted([(1, "[REDACTED_EMAIL]\r\nplain\n", 1, ["email"]), (1, "x\u2028[REDACTED_EMAIL]\r[REDACTED_PASSWORD_KV]", 2, ["email", "password_kv"]), (2, None, 0, [])], key=str)


def test_screens_miss_nothing(spark):
    """With and without the plain strings, every detector finds the same."""
    from veilspark.functions import columns
    from veilspark.functions.catalog import DETECTORS, LITERALS

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    plain = [d for d in DETECTORS if d.name in LITERALS]
    sums = texts.agg(*[F.sum(F.regexp_count("text", F.lit(columns.java(d)))).alias(f"a{i}") for i, d in enumerate(plain)], *[F.sum(detection.count_matches(F.col("text"), d)).alias(f"b{i}") for i, d in enumerate(plain)]).first()
    assert all(sums[f"a{i}"] == sums[f"b{i}"] for i in range(len(plain))) and sum(sums[f"a{i}"] for i in range(len(plain)))


def test_inventory_tells_full_text_tables(spark, tmp_path):
    at = tmp_path / "f.db"
    db = sqlite3.connect(at)
    db.executescript("CREATE TABLE plain(a); INSERT INTO plain(rowid, a) VALUES (7, 'x'); CREATE VIRTUAL TABLE ft USING fts5(body); CREATE VIRTUAL TABLE silent USING fts5(body, content=''); CREATE TABLE ft_other(a)")
    db.commit()
    db.close()
    found = spark.createDataFrame([(str(at), at.read_bytes()), ("bad", b"no database")], "path string, content binary")
    got = {(r.table_name, r.kind, bool(r.error)) for r in sqlite.sqlite_inventory(found).collect()}
    assert {("plain", "table", False), ("ft", "full_text", False), ("silent", "full_text", True), ("ft_content", "shadow", False), ("ft_other", "table", False), (None, None, True)} <= got
    assert [r.row_id for r in sqlite.sqlite_cells(found).where("table_name = 'plain'").collect()] == [7]


def test_database_is_handled_and_swept(spark):
    """A known kind: its tables are emptied, what the handler leaves is swept; an unknown kind is swept alone."""
    urls = spark.createDataFrame([("https://x.org",)], "url string")
    other = spark.createDataFrame([("mail a@b.org", "v")], "memo string, email string")
    known = platforms.sanitize_database({"urls": urls, "visits": urls, "visit_source": urls, "extra": other}, select(only=["email", "identity"]))
    assert known.db_type == "chrome_history" and known.tables["urls"].rows.isEmpty() and known.tables["urls"].counts.first().events == 1
    assert known.tables["extra"].rows.first() == ("mail [REDACTED_EMAIL]", "[REDACTED]")
    assert {r.evidence for r in known.tables["extra"].evidence.collect()} == {"email", "sensitive_column:email"}
    unknown = platforms.sanitize_database({"urls": urls, "extra": other}, select(only=["email"]))
    assert unknown.db_type is None and unknown.tables["urls"].rows.count() == 1 and platforms.sanitize_database({}).tables == {}


def test_paths_done_inside_and_beside(spark):
    rows = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    acted = spark.createDataFrame([("plist_sanitize", "a/x.plist", None), ("plist_sanitize", "a/y.plist", "failed"), ("delete", "a/z.plist", None)], "action string, path string, error string")
    assert sorted(values(paths.not_done(rows("a/x.plist", "a/y.plist", "a/z.plist"), acted, "plist_sanitize"), "path")) == ["a/y.plist", "a/z.plist"]
    assert sorted(values(paths.outside(rows("a/b/c", "a/bc", "d", "a/b"), rows("a/b/", "e")), "path")) == ["a/b", "a/bc", "d"]
    got = {(r.action, r.path) for r in paths.companion_actions(rows("x.db", "x.db-wal", "y.db-SHM", "z-wal.txt")).collect()}
    assert got == {("delete_companion", "x.db-wal"), ("delete_orphan", "y.db-SHM")}
    errors = spark.createDataFrame([("update", "t", f"c{i:03d}") for i in range(150)], "operation string, table_name string, column_name string")
    counted, first = manifest.error_evidence(errors)
    assert counted.first()[0] == 150 and values(first, "column_name") == [f"c{i:03d}" for i in range(100)]


def test_statements_of_a_rule(spark):
    """In order, each on what is left; what can't run is an error and stops no other; LIKE ignores case; quotes and names as in SQLite."""
    assert rules.portable("UPDATE \"a`b\" SET x = 'it''s \\ like' WHERE y like '%LIKE%'") == "UPDATE `a``b` SET x = 'it\\'s \\\\ like' WHERE y ILIKE '%LIKE%'"
    know = spark.createDataFrame([("/app/Safari", "x"), ("/app", "com.apple.x"), ("/app", "org.y"), (None, None), ("Contacts", "q")], "ZSTREAMNAME string, ZVALUESTRING string")
    more = ["DROP TABLE x", "rubbish", "DELETE FROM nowhere", "UPDATE zobject SET nope = 1", "UPDATE place SET lat = 'it''s', id = id + 1 WHERE \"id\" = 2", "UPDATE place SET id = 0 WHERE lat = 'it''s'"]
    place = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, lat double")
    got = rules.apply_rules({"zobject": know, "place": place, "kept": know}, [*rules.rules_of("/x/CoreDuet/Knowledge/knowledgec.db"), *more], spark)
    assert sorted(map(str, got.tables["zobject"].collect())) == sorted(map(str, spark.createDataFrame([("/app", "com.apple.x"), ("/app", "[REDACTED]"), (None, None)], know.schema).collect()))
    assert [tuple(r) for r in got.tables["place"].orderBy("id").collect()] == [(0, "it's"), (1, "0.5"), (3, None)] and got.tables["kept"] is know
    assert {(r.position, r.rows_affected) for r in got.counts.collect()} == {(0, 3), (1, 1), (2, 0), (3, 0), (4, 1), (9, 1), (10, 1)}
    assert Counter(r.operation for r in got.errors.collect()) == {"parse": 2, "delete": 1, "update": 1}
    assert rules.rules_of("a/TCC.db") is None and rules.rules_of("Library/TCC/TCC.db") == () and rules.apply_rules({}, [], spark).counts.isEmpty()
    with pytest.raises(ValueError):
        rules.apply_rules({"t": spark.createDataFrame([("x",)], "_alive_ string")}, ["DELETE FROM t"], spark)


def test_devices_and_integrity(spark, tmp_path):
    root = "private/var/mobile/Containers/Data/Application/"
    some = spark.createDataFrame([(root + "A/Documents/x",), (root + "A/y/SILEO.db",), (root + "B/z",), (root + "loose",), ("x/" + root + "C/sileo",), (None,)], "path string")
    assert {tuple(r) for r in paths.container_actions(some).collect()} == {("preserve", root + "A", "jailbreak app"), ("delete_directory", root + "B", "third-party app")}
    assert paths.container_actions(some, acted_on=False).isEmpty() and paths.container_actions(some.limit(0)).isEmpty()
    assert paths.times_normalized(some).first().epoch_ts == 946684800
    assert values(paths.foreign_databases(spark.createDataFrame([("a\\WebCacheV01.dat",), ("b/webcachev01.DAT",), ("c",), (None,)], "path string")), "check") == ["database"] * 2
    passed, failed = (spark.createDataFrame([(x,)], "passed boolean") for x in (True, False))
    wrong, none = spark.createDataFrame([("x",)], "error string"), spark.createDataFrame([], "error string")
    assert [manifest.exit_status(*a).first().status for a in ((passed,), (failed,), (passed, none), (passed, wrong), (failed, wrong))] == [0, 2, 0, 1, 1]
    assert verification.integrity(some, some, "t").isEmpty() and values(verification.integrity(some, some.limit(2), "t"), "reason") == ["rows: 6 before, 2 after"]
    assert values(verification.integrity(some, some.select(F.col("path").alias("p")), "t"), "reason") == ["columns differ"] and verification.integrity(some, some.limit(0), "t", emptied=True).isEmpty()
    assert not verification.verify(spark.createDataFrame([], verification.MATCH), verification.integrity(some, some.limit(2), "t")).verdict.first().passed
    version = [("System/Library/CoreServices/SystemVersion.plist", plistlib.dumps({"ProductVersion": "15.4"}, fmt=plistlib.FMT_BINARY)), ("x", b"")]
    found = spark.createDataFrame(version, "path string, content binary")
    assert [files.os_version(f).first().version for f in (found, found.limit(0), found.where("path = 'x'"))] == ["15.4", "unknown", "unknown"]
    for text, separator in (('a;b;c\n1;"x, ; y";2\n\n3;4,5;6\n', ";"), ("a\tb\n1\t2\n", "\t"), ("plain\n", ","), ("", ","), ("a,b\n1,2\n", ",")):
        (tmp_path / "f.csv").write_text(text)
        assert files.separator_of(spark, str(tmp_path / "f.csv")) == separator
    (tmp_path / "f.csv").write_text("a|b\n1|2,3\n")
    assert files.read_csv(spark, str(tmp_path / "f.csv"), None).first().b == "2,3"
    with pytest.raises(ValueError):
        named("a\0b")
