"""Operator 9: fuzzy line deduplication by MinHash over character shingles.

Lines (separated by a line feed) with a word are hashed to 128 bits, equal lines being one. Each distinct line gets
`bands` * `rows` minima over its shingles of q code points, and every band's minima give a bucket; at similarity 0.8
the chance to share none of the 9 buckets of 4 minima is below 0.01. A bucket connects its lines to the smallest;
components of buckets are candidates only: inside each one every pair is verified by exact Jaccard similarity (with
tree bounds, see the Jaccard join), and what is linked becomes a class by union-find. Of each class the first line,
by id and position, stays; the others go. Lines without a word stay.

Defined results: a null or empty text has no line with a word; a line shorter than q is one shingle; a null id comes
first in the order, rows with equal ids follow each other by an order of their texts; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.blooms import bloom_of, may_hold
from veilspark.llm.components import connected_components
from veilspark.llm.jaccard_join import JaccardRule, verified
from veilspark.llm.runtime import batches, released, tasks_for, written
from veilspark.llm.textbytes import mix, powers

BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRule:
    q: int = 8
    percent: int = 80
    bands: int = 9
    rows: int = 4
    tile_sets: int = 64
    tile_bytes: int = 6 << 20


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


SHIFT = 0xD1342543DE82EF95
BACK = pow(SHIFT, -1, 1 << 64)


def char_shingles(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of q code points of each line, with offsets; a shorter line is one run."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = len(chars)
    chars += np.uint64(0x632BE59BD9B4E019)
    chars *= np.uint64(0x9E3779B97F4A7C15)
    chars ^= chars >> np.uint64(29)
    chars *= powers(SHIFT, n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(chars, out=prefix[1:])
    counts = np.where(sizes >= q, sizes - q + 1, (sizes > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], counts)
    ends = starts + np.repeat(np.minimum(sizes, q), counts)
    hashes = (prefix[ends] - prefix[starts]) * powers(BACK, n + 1)[starts]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    return hashes, offsets


def line_sets(lines: list[bytes], q: int) -> list[np.ndarray]:
    hashes, offsets = char_shingles([x.decode() for x in lines], q)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = np.sort(hashes[a:b])
        new = own[1:] != own[:-1]
        out.append(own if new.all() else own[np.concatenate([[True], new])])
    return out


def band_hashes(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row for each line (none of them empty), one bucket number for each band. A hash's 32 bits times an odd
    number are its place in one permutation."""
    rng = np.random.default_rng(20240307)
    low = hashes.astype(np.uint32)
    value = np.empty_like(low)
    out = np.empty((len(offsets) - 1, bands), np.int64)
    for b in range(bands):
        joined = np.full(len(offsets) - 1, np.uint64(b + 1))
        for _ in range(rows):
            np.multiply(low, np.uint32(int(rng.integers(0, 1 << 32)) | 1), out=value)
            joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, offsets[:-1]))
        out[:, b] = joined.view(np.int64)
    return out


def _described(docs: DataFrame, rule: LineRule) -> DataFrame:
    """A row for each document: the names of its lines (null without a word), and the buckets of lines that are new in the task."""
    kind = dict(docs.dtypes)["id"]
    fresh_type = pa.list_(pa.struct([("key", pa.int64()), ("buckets", pa.list_(pa.int64()))]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                names, counts, new, order = [], [], [], []
                for text in part.column("text").to_pylist():
                    own: list[bytes | None] = []
                    counts.append(0)
                    for line in _lines(text):
                        if not line.strip(BLANKS):
                            own.append(None)
                            continue
                        name = xxhash.xxh3_128_digest(line.encode())
                        own.append(name)
                        if name not in seen:
                            seen.add(name)
                            new.append(line)
                            order.append(int.from_bytes(name[:8], "big", signed=True))
                            counts[-1] += 1
                    names.append(own)
                buckets = band_hashes(*char_shingles(new, rule.q), rule.bands, rule.rows) if new else np.zeros((0, rule.bands), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * rule.bands, pa.int32()), pa.array(buckets.reshape(-1)))
                fresh = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(order, pa.int64()), lists], fields=list(fresh_type.value_type)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array(names, pa.list_(pa.binary())), fresh], names=["id", "digest", "lines", "fresh"])

    return docs.mapInArrow(released(run), f"id {kind}, digest binary, lines array<binary>, fresh array<struct<key:long,buckets:array<long>>>")


def _stars(described: DataFrame) -> DataFrame:
    """(head, a, b): edges from lines to the smallest of their bucket in the batch (head false), and that smallest one
    for each bucket of the batch (head true: bucket, key), so that no bucket sends more than one row from a batch."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            fresh = batch.column("fresh").flatten()
            if not len(fresh):
                continue
            keys, lists = np.asarray(fresh.field("key")), fresh.field("buckets")
            yield from star_rows(np.asarray(lists.flatten()), np.repeat(keys, np.asarray(pc.list_value_length(lists))), heads=True)

    return described.select("fresh").mapInArrow(released(run), "head boolean, a long, b long")


def star_rows(bucket: np.ndarray, key: np.ndarray, heads: bool) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    least = np.repeat(key[cuts], np.diff(np.concatenate([cuts, [len(key)]])))
    edge = key != least
    for head, a, b in ((False, key[edge], least[edge]), (True, bucket[cuts], key[cuts])):
        for i in range(0, len(a) if heads or not head else 0, 100_000):
            part = pa.array(a[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([head] * len(part)), part, pa.array(b[i : i + 100_000])], names=["head", "a", "b"])


def _edges(stars: DataFrame, rows: int) -> DataFrame:
    """The tasks' edges, and edges between their smallest lines of each bucket."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in frames if len(b)]
        if not found:
            return
        head, a, b = (np.asarray(x) for x in pa.Table.from_batches(found).combine_chunks().columns)
        for i in range(0, int((~head).sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[~head][i : i + 100_000]) for x in (a, b)], names=["a", "b"])
        if head.any():
            for batch in star_rows(a[head], b[head], heads=False):
                yield batch.select(["a", "b"])

    return stars.repartition(tasks_for(stars.sparkSession, rows, 4_000_000), "a").mapInArrow(released(run), "a long, b long")


def _sets_of(docs: DataFrame, comps: DataFrame, rule: LineRule) -> DataFrame:
    """(name, members, comp) of the lines whose key is in comps, each once; members is the line itself."""
    held = bloom_of(comps.select(F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("key")), "key")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = may_hold(held.value)
        seen: set[bytes] = set()
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                names, lines = [], []
                for text in batch.column("text").slice(lo, hi - lo).to_pylist():
                    for line in _lines(text):
                        if line.strip(BLANKS):
                            name = xxhash.xxh3_128_digest(line.encode())
                            if name not in seen and hit(name[:8]):
                                seen.add(name)
                                names.append(name)
                                lines.append(line.encode())
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(x[:8], "big", signed=True) for x in names], pa.int64()), pa.array(names, pa.binary()), pa.array(lines, pa.binary())], names=["key", "name", "members"])

    sets = docs.select("text").mapInArrow(released(run), "key long, name binary, members binary")
    return sets.join(comps, "key").groupBy("name").agg(F.first("members").alias("members"), F.first("comp").alias("comp"))


def line_classes(docs: DataFrame, described: DataFrame, rule: LineRule) -> DataFrame | None:
    """(name, label) of the lines that are linked to others; label is the smallest name. None without any."""
    rows = described.agg(F.sum(F.size("fresh"))).first()[0] or 0
    comps = connected_components(_edges(_stars(described), rows * rule.bands))
    if comps.isEmpty():
        return None
    comps = written(comps.select(F.col("node").alias("key"), F.col("label").alias("comp")), "comps")
    sets = written(_sets_of(docs, comps, rule), "sets")
    q = rule.q
    return verified(sets, JaccardRule(percent=rule.percent, tile_sets=rule.tile_sets, tile_bytes=rule.tile_bytes), lambda lines: line_sets(lines, q)).where("name <> label")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: LineRule = LineRule()) -> DataFrame:
    """One row for each document: id_col, n_lines (with a word), n_removed, and removed (the numbers of the lines
    that go, from 0), sorted."""
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))).alias("digest"))
    described = written(_described(docs, rule).withColumn("row", F.monotonically_increasing_id()), "described")
    labels = line_classes(docs, described, rule)
    lines = described.select("id", "digest", "row", F.posexplode("lines").alias("line", "name")).where("name IS NOT NULL")
    first = lines.groupBy("name").agg(F.min(F.struct("id", "digest", "row", "line")).alias("first"))
    if labels is not None:
        first = first.join(labels, "name", "left").groupBy(F.coalesce("label", "name").alias("name")).agg(F.min("first").alias("first"))
    kept = first.groupBy(F.col("first.row").alias("row")).agg(F.collect_list("first.line").alias("kept"))
    out = described.select("id", "row", F.expr("filter(sequence(0, size(lines) - 1), i -> lines[i] IS NOT NULL)").alias("all")).join(kept, "row", "left")
    removed = F.array_except("all", F.coalesce("kept", F.expr("CAST(array() AS array<int>)")))
    return out.select(F.col("id").alias(id_col), F.size("all").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_sort(removed).alias("removed"))


def without_lines(text: str | None, removed: list[int]) -> str | None:
    """The text without the lines of these numbers."""
    if text is None:
        return None
    gone = set(removed)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
