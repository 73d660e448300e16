from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import functions as F

from veilspark.operators import artifacts, media


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def test_documents(spark):
    pdf = b"%PDF-1.4 /Info << /Author (Jo \\(x\\) Doe) /Title <4A6F> >> <dc:creator><rdf:Seq><rdf:li>Jo</rdf:li></rdf:Seq></dc:creator> <x pdf:Producer=\"P\"/><xmp:CreatorTool>T</xmp:CreatorTool>"
    hidden = b"%PDF stream\n" + zlib.compress(b"/Author (x)") + b"\nendstream"
    word = archive({"docProps/core.xml": "<cp:p><dc:creator>Jo</dc:creator><dc:title/></cp:p>", "word/document.xml": '<w:ins w:author="Jo" w:id="1"/>', "docProps/custom.xml": "<p><vt:lpwstr>Jo</vt:lpwstr></p>", "x.txt": "keep"})
    hostile = archive({"docProps/core.xml": "<!DOCTYPE a><dc:creator>Jo</dc:creator>"})
    rows = [("a.pdf", pdf), ("b.PDF", hidden), ("c.docx", word), ("d.odt", hostile), ("e.docx", b"no zip"), ("f.txt", b"x")]
    got = {r.path: r.stripped for r in media.strip_metadata(spark.createDataFrame(rows, "path string, content binary"), "path", "content").collect()}
    a = bytes(got["a.pdf"].content)
    assert len(a) == len(pdf) and b"Jo" not in a and b"4A6F" not in a and b'"P"' not in a and b">T<" not in a and got["a.pdf"].fields == 5 and got["a.pdf"].incomplete is None
    assert got["b.PDF"].incomplete and got["f.txt"] is None and got["e.docx"].incomplete
    with zipfile.ZipFile(io.BytesIO(bytes(got["c.docx"].content))) as z:
        assert b"Jo" not in b"".join(z.read(n) for n in z.namelist()) and z.read("x.txt") == b"keep"
    assert got["c.docx"].fields == 3 and got["d.odt"].incomplete and bytes(got["d.odt"].content) == hostile


def test_pdf_strings_and_streams():
    nested = b"/Title (a (b (c) \\) d) e) /Author(open"
    out, n, why = media.strip_pdf(nested)
    assert out == b"/Title (" + b" " * 16 + b") /Author(open" and n == 1 and why is None
    assert media.strip_pdf(b"/Author <</X 1>> /Producer <414\n2>")[1] == 1
    assert media.strip_pdf(b"/Author (" + b"(\\" * 200_000)[1] == 0  # linear, however deep
    bomb = b"stream\n" + zlib.compress(b"\0" * (3 << 20)) + b"\nendstream"
    assert media.strip_pdf(bomb, limit=1 << 20)[2] == "a compressed stream over the limit" and media.strip_pdf(bomb)[2] is None
    split = b"stream\r\n" + zlib.compress(b"x" * ((1 << 20) - 3) + b"/Author (x)") + b"endstream"
    assert media.strip_pdf(split)[2] == "metadata in a compressed stream"
    assert media.strip_pdf(b"<dc:creator><rdf:li>Jo")[2] == "an element does not end"
    out, n, _ = media.strip_pdf(b"<dc:title a='>'>T<b/>U</dc:title><x xmp:Author='P\"Q'/>")
    assert out == b"<dc:title a='>'> <b/> </dc:title><x xmp:Author='   '/>" and n == 3


def test_office_archives():
    def one(name, part):
        return media.strip_office(archive({name: part, "z": "keep"}))

    odd = one("docProps/core.xml", "<a:p xmlns:a='u'><q:creator xmlns:q='v'>J&amp;o<!-- c -->e</q:creator><creator/><x>stay</x></a:p>")
    with zipfile.ZipFile(io.BytesIO(odd[0])) as z:
        assert z.read("docProps/core.xml") == b"<a:p xmlns:a='u'><q:creator xmlns:q='v'><!-- c --></q:creator><creator/><x>stay</x></a:p>" and odd[1] == 2 and z.read("z") == b"keep"
    assert one("meta.xml", "<a><creator>Jo</a>")[2].startswith("meta.xml: not well-formed")
    assert one("meta.xml", "<?xml version='1.0' encoding='utf-16'?><a/>".encode("utf-16"))[2] == "meta.xml: not UTF-8"
    assert one("meta.xml", "<a>" + " " * (33 << 20) + "</a>")[2] == "meta.xml: too large"
    assert one("word/comments.xml", "<c w15:userId='a>b' w:author=\"Jo\" w:x='y'/>")[1] == 2
    assert media.strip_office(archive({"meta.xml": "<a><creator>Jo</creator></a>", "big": "x" * 5000}), limit=1000)[2] == "archive over the limit"


def test_unchecked_media(spark):
    files = spark.createDataFrame([("a/B.JPG",), ("a/c.txt",), (None,), ("d.mov",)], "path string")
    assert sorted(r.path for r in media.unchecked_media(files).collect()) == ["a/B.JPG", "d.mov"]


def test_artifacts(spark):
    rows = [("a/Cache/x", "cache"), ("a/DocumentCache/x", None), ("Library/Caches/y", "cache"), ("a/~$doc.docx", "swap"), ("a/x.TMP", "swap"), ("CrashReporter/a", "crash"), ("a/b.ips", "crash"), ("x/Foo_leveldb/1", "leveldb"), ("x/.DS_Store", "artifact"), ("x/.ds_store", None), ("x/$Iabc", "artifact"), ("DCIM/.thumbnails/1", "artifact"), ("plain/file", None)]
    df = spark.createDataFrame(rows, "path string, kind string")
    assert all(r.kind == r.got for r in df.withColumn("got", artifacts.artifact_kind(F.col("path"))).collect())
    assert artifacts.artifact_actions(df).count() == 10
    stores = spark.createDataFrame([("s/CURRENT",), ("s/MANIFEST-1",), ("t/CURRENT",), ("u/1.ldb",)], "path string")
    assert [r.directory for r in artifacts.leveldb_stores(stores).collect()] == ["s"]
