"""Metadata of PDF and office documents, blanked in binary columns.

PDF files are not parsed as a whole: names of the document information and the elements and attributes of embedded
XML are looked up, and their values overwritten in place, so that all offsets stay right. Office archives are walked
part by part with an XML parser that refuses document types; what it reports as values is cut out of the part's
bytes. Everything is read up to a limit. What can't be looked into gives a reason, and the file stays as it is.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.columns import named

#: Bytes that one compressed stream, and one archive as a whole, may unfold to.
STREAM_LIMIT = 64 << 20
ARCHIVE_LIMIT = 512 << 20
_PDF_BLANKS = b"\0\t\n\f\r "


class _Blanks:
    """Byte ranges to overwrite; those that hold something are counted."""

    def __init__(self, data: bytes):
        self.data, self.count = bytearray(data), 0

    def put(self, start: int, end: int, fill: int = 0x20) -> None:
        held = bytes(self.data[start:end])
        blank = bytes([fill]) * (end - start)
        self.count += held != blank and bool(held.strip(_PDF_BLANKS))
        self.data[start:end] = blank


def pdf_string(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Start and end of the inside of the string object at `at`, after white space, and what it is blanked with; null
    without a string there. Literal strings count their parentheses, of which escaped ones don't matter."""
    n = len(data)
    while at < n and data[at] in _PDF_BLANKS:
        at += 1
    if data[at : at + 1] == b"<" and data[at + 1 : at + 2] != b"<":
        end = data.find(b">", at)
        return (at + 1, end, 0x30) if end >= 0 else None
    if data[at : at + 1] != b"(":
        return None
    start, depth = at + 1, 1
    for m in re.compile(rb"[()\\]").finditer(data, start):
        if m.start() < at:
            continue
        if m.group() == b"\\":
            at = m.start() + 2
            continue
        depth += 1 if m.group() == b"(" else -1
        if not depth:
            return start, m.start(), 0x20
    return None


def _tag_end(data: bytes, at: int) -> int:
    """Just behind the tag that starts at `at`; quoted values may hold any character. -1 if it doesn't end."""
    quote = 0
    for m in re.compile(rb"[\"'>]").finditer(data, at):
        c = data[m.start()]
        if quote:
            quote = 0 if c == quote else quote
        elif c == 0x3E:
            return m.end()
        else:
            quote = c
    return -1


def _blank_xmp(data: bytes, out: _Blanks) -> str | None:
    """Character data of known elements, with whatever stands inside them, and values of known attributes."""
    names = b"|".join(re.escape(x.encode()) for x in (*C.XMP_CONTAINERS, *C.XMP_PROPERTIES))
    open_: list[tuple[bytes, int]] = []
    regions: list[tuple[int, int]] = []
    for m in re.finditer(rb"<(/?)(" + names + rb")(?=[\s/>])", data):
        if m.group(1):
            if any(name == m.group(2) for name, _ in open_):
                while (top := open_.pop())[0] != m.group(2):
                    pass
                regions.append((top[1], m.start()))
            continue
        end = _tag_end(data, m.end())
        if end < 0:
            return "an element does not end"
        if data[end - 2] != 0x2F:
            open_.append((m.group(2), end))
    for start, end in regions:
        at = start
        while at < end:
            tag = data.find(b"<", at, end)
            out.put(at, tag if tag >= 0 else end)
            at = _tag_end(data, tag) if tag >= 0 else end
            if at < 0:
                return "an element does not end"
    for m in re.finditer(rb"(?<=[\s\"'])(?:" + names + rb")\s*=\s*([\"'])", data):
        end = data.find(m.group(1), m.end())
        if end < 0:
            return "an attribute does not end"
        out.put(m.end(), end)
    return "an element does not end" if open_ else None


def _streams(data: bytes) -> Iterator[bytes]:
    """The raw bytes of stream objects."""
    at = 0
    while (at := data.find(b"stream", at)) >= 0:
        start = at + 6
        if data[at - 3 : at] == b"end" or data[start : start + 1] not in (b"\r", b"\n"):
            at = start
            continue
        start += 2 if data[start : start + 2] == b"\r\n" else 1
        end = data.find(b"endstream", start)
        if end < 0:
            return
        yield data[start:end]
        at = end + 9


def _hidden(stream: bytes, limit: int) -> str | None:
    """Whether a deflated stream holds metadata, or unfolds to more than the limit."""
    markers = [x.encode() for x in C.PDF_MARKERS]
    longest = max(map(len, markers))
    unfold, tail, size, rest = zlib.decompressobj(), b"", 0, stream
    try:
        while rest and not unfold.eof:
            part = unfold.decompress(rest, 1 << 20)
            rest = unfold.unconsumed_tail
            size += len(part)
            if any(x in tail + part for x in markers):
                return "metadata in a compressed stream"
            if size > limit:
                return "a compressed stream over the limit"
            tail = part[-longest:]
    except zlib.error:
        return None
    return None


def strip_pdf(data: bytes, limit: int = STREAM_LIMIT) -> tuple[bytes, int, str | None]:
    """Bytes of the same length, the number of values blanked, and why metadata may be left."""
    out = _Blanks(data)
    keys = {k.encode() for k in C.PDF_KEYS}
    for m in re.finditer(rb"/([A-Za-z]+)", data):
        if m.group(1) in keys and (found := pdf_string(data, m.end())):
            out.put(*found)
    why = _blank_xmp(data, out)
    for stream in _streams(data):
        why = why or _hidden(stream, limit)
    return bytes(out.data), out.count, why


class Refused(ValueError):
    """A part that isn't looked into."""


def _values(name: str, xml: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the values in a part of an office archive that tell about persons or tools."""
    if xml[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise Refused("not UTF-8")
    tags, found = C.OFFICE_TAGS.get(name), []
    attributes = {f"{p}:{a}" for p in ("w", "w15") for a in ("author", "initials", "userId")} if name in C.OFFICE_PERSON_PARTS else set()
    parser = expat.ParserCreate()
    wanted, begun = [False], [-1]

    def close() -> None:
        if begun[0] >= 0:
            found.append((begun[0], parser.CurrentByteIndex))
            begun[0] = -1

    def start(tag: str, values: dict[str, str]) -> None:
        close()
        prefix, _, local = tag.rpartition(":")
        wanted.append(local in tags if tags else name == C.OFFICE_CUSTOM_PART and prefix == "vt")
        if attributes & values.keys():
            at = parser.CurrentByteIndex
            for m in re.finditer(rb"([^\s=\"'<]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", xml[at : _tag_end(xml, at)]):
                if m.group(1).decode() in attributes:
                    k = 2 if m.group(2) is not None else 3
                    found.append((at + m.start(k), at + m.end(k)))

    def end(_: str) -> None:
        close()
        wanted.pop()

    def text(_: str) -> None:
        if wanted[-1] and begun[0] < 0:
            begun[0] = parser.CurrentByteIndex

    def refuse(*_: object) -> None:
        raise Refused("document type refused")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: close()
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise Refused(f"not well-formed: {expat.errors.messages.get(e.code, e.code)}") from None
    return [(a, b) for a, b in found if xml[a:b].strip()]


def strip_office(data: bytes, limit: int = ARCHIVE_LIMIT) -> tuple[bytes, int, str | None]:
    """The archive without values, the number of values, and why it stays as it is."""
    parts, total, errors = {}, 0, []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as old:
            for info in old.infolist():
                if info.filename not in (*C.OFFICE_TAGS, *C.OFFICE_PERSON_PARTS, C.OFFICE_CUSTOM_PART):
                    continue
                with old.open(info) as part:
                    xml = part.read(C.XML_LIMIT + 1)
                try:
                    if len(xml) > C.XML_LIMIT:
                        raise Refused("too large")
                    at, kept = 0, []
                    for a, b in _values(info.filename, xml):
                        kept.append(xml[at:a])
                        at, total = b, total + 1
                    parts[info.filename] = b"".join([*kept, xml[at:]])
                except Refused as e:
                    errors.append(f"{info.filename}: {e}")
            if errors:
                return data, 0, "; ".join(errors)
            if not total:
                return data, 0, None
            out, left = io.BytesIO(), limit
            with zipfile.ZipFile(out, "w") as new:
                for info in old.infolist():
                    copy = zipfile.ZipInfo(info.filename)
                    copy.compress_type = info.compress_type
                    with new.open(copy, "w") as to:
                        if info.filename in parts:
                            to.write(parts[info.filename])
                            continue
                        with old.open(info) as source:
                            while piece := source.read(1 << 20):
                                left -= len(piece)
                                if left < 0:
                                    return data, 0, "archive over the limit"
                                to.write(piece)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, zlib.error) as e:
        return data, 0, f"unreadable: {type(e).__name__}"
    return out.getvalue(), total, None


def strip_metadata(df: DataFrame, path: str, content: str, out: str = "stripped") -> DataFrame:
    """df with `out`: struct (content, fields, incomplete); null for other kinds of files, whose bytes stay in the JVM.
    Where incomplete is set the file is not certified."""

    @F.pandas_udf("content binary, fields int, incomplete string")
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for name, raw in zip(names, contents, strict=True):
            rows.append((None, 0, "unreadable") if raw is None else strip_pdf(raw) if name.lower().endswith(".pdf") else strip_office(raw))
        return pd.DataFrame(rows, columns=["content", "fields", "incomplete"])

    known = F.coalesce(F.lower(F.col(named(path))).rlike(r"\.(pdf|docx|xlsx|pptx|odt|ods|odp)$"), F.lit(False))
    sent = F.when(known, F.col(named(content)))  # computed ahead of Python, unlike a condition around the call
    return df.withColumn(out, F.when(known, run(F.col(named(path)), sent)))


def unchecked_media(files: DataFrame) -> DataFrame:
    """Rows (check, path, reason) for images and recordings: no tool here has looked at their metadata."""
    low = F.lower("path")
    suffixes = "|".join(s[1:] for s in sorted({*C.MEDIA_SUFFIXES, *C.STRIPPED_SUFFIXES}))
    return files.where(low.rlike(rf"\.({suffixes})$")).select(F.lit("media_metadata").alias("check"), "path", F.lit("no tool has checked it").alias("reason"))
