"""Operator 7: n-gram Jaccard join with a count-vector R-tree.

A document's set is hashed to 128 bits, so that copies are one node. Candidate links: two sets of Jaccard >= t
share one of their first |x| - ceil(t |x|) + 1 shingles in any common order; the order puts shingles first that are
rare by a count-min sketch over all documents. The sets that share such a shingle form a bucket. In a bucket the
shingles' hashes are counted in groups; the counts are points of an R-tree, and a pair of subtrees, or of points,
whose summed coordinate minima cannot reach the overlap that t asks for is pruned. What stays is contracted
to connected candidate components (never to all pairs); a bucket of more than `dense` sets is taken as connected.

Verification reads the texts again, keeps the sets of candidate components only (by a Bloom filter of bounded size,
then by an exact join), and runs the R-tree with exact overlaps inside each component. A component of more than
`tile_sets` sets is cut into tiles: first inside the tiles, then over one set for each link class of a tile, and, for
the components that are then still apart, over the pairs of blocks of tiles whose sizes allow links, where bitmaps of
the sets prune. Every pair of sets in one component is so either checked, pruned by a bound, or already connected: no
link is lost.

Defined results: a text without words, or null, has no shingles and is linked with nothing; fewer words than k form
one shingle; a null id counts as no id (component_id is the smallest that is not null); rows with equal ids are
ordinary rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.blooms import bloom_of, may_hold, sum_blobs
from veilspark.llm.components import Forest, connected_components
from veilspark.llm.runtime import batches, fresh_name, join_salted, released, tasks_for, written
from veilspark.llm.textbytes import LOWER, Chunk, mix, shingles

LEAF = 16


@dataclass(frozen=True)
class JaccardRule:
    """percent: the least Jaccard similarity. groups: the least number of coordinates of a count vector."""

    k: int = 4
    percent: int = 85
    groups: int = 32
    dense: int = 2000
    tile_sets: int = 64
    tiles: int = 64
    tile_limit: int = 4000
    tile_bytes: int = 48 << 20
    block_sets: int = 1000
    sketch_bits: int = 18


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    chunk = Chunk(column, LOWER)
    starts, ends, first = chunk.words()
    rolled, offsets = shingles(chunk.span_hash(starts, ends), first, k)
    for i in range(chunk.n):
        own = rolled[offsets[i] : offsets[i + 1]]
        if len(own) > 1:
            own = np.sort(own)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        yield own


def digest(own: np.ndarray) -> tuple[int, bytes]:
    """A 64-bit key (of the candidate graph) and a 128-bit name of a set."""
    name = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(name[:8], "big", signed=True), name


def group_count(n: int, least: int) -> int:
    """A power of two near n / 8: unlike sets then differ by more counts than the threshold lets them, at any size."""
    return max(least, 1 << max(0, -(-n // 8) - 1).bit_length())


def counts_of(own: np.ndarray, least: int) -> np.ndarray:
    return np.bincount(((own >> np.uint64(40)) & np.uint64(group_count(len(own), least) - 1)).astype(np.int64), minlength=group_count(len(own), least))


def counted(own: np.ndarray, least: int) -> bytes:
    """Counts by group in bytes, rounded up to a multiple of a power of two that comes first."""
    counts = counts_of(own, least)
    scale = 0
    while counts.max() > 255 << scale:
        scale += 1
    return bytes([scale]) + (-(-counts >> scale)).astype(np.uint8).tobytes()


def point(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8, offset=1).astype(np.int64) << blob[0]


class CountTree:
    """An R-tree over count vectors, packed by size; pairs() walks it against itself."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.lexsort((*vectors.T[:2], sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        level = [np.arange(i, min(i + LEAF, len(sizes))) for i in range(0, len(sizes), LEAF)]
        top = np.stack([self.vectors[r].max(axis=0) for r in level])
        low, high = (np.array([f(self.sizes[r]) for r in level]) for f in (np.min, np.max))
        self.leaves, self.levels = level, [(top, low, high)]
        while len(top) > 1:
            cuts = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def need(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The least overlap of sets of these sizes."""
        return -(-(x + y) * self.percent // (100 + self.percent))

    def pairs(self, linked: Callable[[np.ndarray, np.ndarray], bool], offer: Callable[[int, int], None]) -> None:
        """Offers every pair that the bounds allow, but those in subtrees of which linked() knows that they are one."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            top, low, high = self.levels[level]
            if i != j:
                if 100 * high[i] < self.percent * low[j] or 100 * high[j] < self.percent * low[i] or np.minimum(top[i], top[j]).sum() < self.need(low[i], low[j]):
                    continue
            if level:
                n = len(self.levels[level - 1][0])
                a, b = range(i * LEAF, min((i + 1) * LEAF, n)), range(j * LEAF, min((j + 1) * LEAF, n))
                stack += [(level - 1, x, y) for x in a for y in b if i != j or x <= y][::-1]
                continue
            a, b = self.leaves[i], self.leaves[j]
            if linked(self.order[a], self.order[b]):
                continue
            bound = np.minimum(self.vectors[a][:, None], self.vectors[b][None]).sum(axis=2)
            x, y = self.sizes[a][:, None], self.sizes[b][None]
            ok = (bound >= self.need(x, y)) & (100 * x >= self.percent * y) & (100 * y >= self.percent * x)
            if i == j:
                ok = np.triu(ok, 1)
            for p, q in zip(*np.nonzero(ok), strict=True):
                offer(int(self.order[a[p]]), int(self.order[b[q]]))


def offer_pairs(points: list[np.ndarray], sizes: np.ndarray, percent: int, forest: Forest, offer: Callable[[int, int], None]) -> None:
    """Offers the pairs that the bounds allow and that the forest does not connect yet. Points of one length meet in
    a tree; those of the next length, folded by half, meet them in a tree as well (sizes that differ more than
    twofold are never linked)."""
    lengths = np.array([len(p) for p in points])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        most = sizes[own].max() * 100 // percent
        above = np.flatnonzero((lengths == 2 * length) & (sizes <= most))
        for rows in (own, np.concatenate([own, above])) if len(above) else (own,):
            if len(rows) < 2:
                continue
            vectors = np.stack([points[r] if len(points[r]) == length else points[r].reshape(2, -1).sum(axis=0) for r in rows])
            both = len(rows) > len(own)
            tree = CountTree(vectors, sizes[rows], percent)
            tree.pairs(
                lambda a, b, rows=rows: len({forest.find(int(rows[v])) for v in (*a, *b)}) == 1,
                lambda x, y, rows=rows, both=both: offer(int(rows[x]), int(rows[y])) if not both or lengths[rows[x]] != lengths[rows[y]] else None,
            )


def candidate_forest(points: list[np.ndarray], sizes: np.ndarray, percent: int) -> Forest:
    """Connects what the bounds allow."""
    forest = Forest(len(sizes))
    offer_pairs(points, sizes, percent, forest, forest.union)
    return forest


def exact_forest(sets: list[np.ndarray], percent: int, classes: list | None = None) -> Forest:
    """Connects what is linked. classes: what is known to be connected."""
    forest = Forest(len(sets))
    seen: dict = {}
    for i, c in enumerate(classes or ()):
        if c is not None:
            forest.union(seen.setdefault(c, i), i)

    def offer(x: int, y: int) -> None:
        if forest.find(x) != forest.find(y):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                forest.union(x, y)

    if len(sets) <= 8:  # no tree pays
        for x in range(len(sets)):
            for y in range(x):
                if 100 * min(len(sets[x]), len(sets[y])) >= percent * max(len(sets[x]), len(sets[y])):
                    offer(x, y)
        return forest
    offer_pairs([counts_of(s, 64) for s in sets], np.array([len(s) for s in sets], np.int64), percent, forest, offer)
    return forest


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A bitmap of each set's hashes. Bitmaps of two sets differ in no more bits than the sets in members."""
    out = np.empty((len(sets), bits // 8), np.uint8)
    for row, own in zip(out, sets, strict=True):
        marks = np.zeros(bits, bool)
        marks[((own >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(marks)
    return out.view(np.uint64)


#: Bytes of bitmaps that are compared at once.
COMPARED = 4 << 20


def across_forest(sets: list[np.ndarray], sides: list[int], percent: int, classes: list) -> Forest:
    """Connects what is linked between the sets of side 0 and those of side 1, or all sets where there is one side.
    Sets of one class count as connected. A pair is compared exactly unless its bitmaps differ in too many bits."""
    forest = Forest(len(sets))
    seen: dict = {}
    for i, c in enumerate(classes):
        forest.union(seen.setdefault(c, i), i)
    sizes, side = np.array([len(s) for s in sets], np.int64), np.array(sides)
    bits = 1 << max(8, (2 * int(sizes.max()) - 1).bit_length())
    maps, own = sketches(sets, bits), np.array([forest.find(i) for i in range(len(sets))])
    first = np.flatnonzero(side == side.min())
    second = np.flatnonzero(side == side.max())
    step = max(1, COMPARED // (len(second) * bits // 8))
    for lo in range(0, len(first), step):
        a = first[lo : lo + step]
        x, y = sizes[a][:, None], sizes[second][None]
        apart = np.bitwise_count(maps[a][:, None] ^ maps[second][None]).sum(axis=2, dtype=np.int64)
        ok = (apart * (100 + percent) <= (100 - percent) * (x + y)) & (own[a][:, None] != own[second][None])
        for p, q in zip(*np.nonzero(ok), strict=True):
            i, j = int(a[p]), int(second[q])
            if forest.find(i) != forest.find(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    forest.union(i, j)
    return forest


def _described(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """A row for each document, and, with n null, one for each task with its part of the sketch."""
    kind = dict(docs.dtypes)["id"]
    cells = 1 << rule.sketch_bits

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, cells), np.int64)
        names = ["id", "digest", "n", "key", "name", "vector"]
        type_ = None
        for batch in frames:
            type_ = batch.column("id").type
            for lo, hi in batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                sets = list(shingle_sets(part.column("text"), rule.k))
                every = np.concatenate(sets)
                for d in range(2):
                    sketch[d] += np.bincount((every >> np.uint64(20 * d)) & np.uint64(cells - 1), minlength=cells)
                keys = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.binary()), pa.array([counted(s, rule.groups) for s in sets], pa.binary())], names=names)
        if type_ is not None and sketch.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, type_), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([zlib.compress(sketch.tobytes(), 1)], pa.binary())], names=names)

    return docs.mapInArrow(run, f"id {kind}, digest long, n long, key long, name binary, vector binary")


def _prefixes(docs: DataFrame, sketch: np.ndarray, rule: JaccardRule) -> DataFrame:
    """(shingle, part, key): the rare shingles of which a partner must share one; a set comes once from each task.
    part spreads a shingle that the sketch counts as frequent, and is -1 for all others."""
    cells = 1 << rule.sketch_bits
    held = docs.sparkSession.sparkContext.broadcast(zlib.compress(sketch.astype(np.int64).tobytes(), 1))  # of one size for any corpus
    frequent = rule.dense + 8 * int(sketch[:cells].sum()) // cells

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zlib.decompress(held.value), np.int64).reshape(2, cells)
        seen: set[int] = set()
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                out, rares, keys, lengths = [], [], [], []
                for own in shingle_sets(batch.column("text").slice(lo, hi - lo), rule.k):
                    key = digest(own)[0]
                    if not len(own) or key in seen:
                        continue
                    seen.add(key)
                    rare = np.minimum(counts[0][own & np.uint64(cells - 1)], counts[1][(own >> np.uint64(20)) & np.uint64(cells - 1)])
                    take = len(own) + (-rule.percent * len(own) // 100) + 1
                    order = np.lexsort((own, rare))[:take]
                    out.append(own[order])
                    rares.append(rare[order])
                    keys.append(key)
                    lengths.append(take)
                if out:
                    key = np.repeat(np.array(keys, np.int64), lengths)
                    part = np.where(np.concatenate(rares) > frequent, key & 63, -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(part), pa.array(key)], names=["shingle", "part", "key"])

    return docs.select("text").mapInArrow(run, "shingle long, part int, key long")


def _grouped(prefixes: DataFrame, dense: int, rows: int) -> DataFrame:
    """(kind, a, b): members of buckets (0: bucket, key), edges (1), and frequent shingles' least keys by part (2:
    shingle, key). A bucket is named by its members, so that shingles of the very same sets give one bucket; it
    has `dense` members at most, larger ones become stars of edges. rows: about how many prefixes there are."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in frames if len(b)]
        if not found:
            return
        table = pa.Table.from_batches(found)
        shingle, part, key = (np.asarray(table.column(c).combine_chunks()) for c in ("shingle", "part", "key"))
        order = np.lexsort((key, part, shingle))
        shingle, part, key = shingle[order], part[order], key[order]
        fresh = np.ones(len(key), bool)
        same = (shingle[1:] == shingle[:-1]) & (part[1:] == part[:-1])
        fresh[1:] = ~same | (key[1:] != key[:-1])
        shingle, part, key = shingle[fresh], part[fresh], key[fresh]
        cuts = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.diff(np.concatenate([cuts, [len(key)]]))
        group = np.repeat(np.arange(len(cuts)), sizes)
        least = key[cuts][group]
        frequent = part[cuts] >= 0
        star = ((sizes > dense) | frequent) & (sizes > 1)
        bucket = (sizes > 1) & ~star
        named = mix(np.add.reduceat(mix(key.view(np.uint64)), cuts) + mix(sizes.astype(np.uint64))).view(np.int64)
        firsts = np.zeros(len(cuts), bool)
        firsts[np.unique(named, return_index=True)[1]] = True  # one of equal buckets in the task
        m = (bucket & firsts)[group]
        e = star[group] & (key != least)
        h = frequent
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [m.sum(), e.sum(), h.sum()])
        a = np.concatenate([named[group[m]], key[e], shingle[cuts[h]]])
        b = np.concatenate([key[m], least[e], key[cuts[h]]])
        for i in range(0, len(kinds), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (kinds, a, b)], names=["kind", "a", "b"])

    return prefixes.repartition(tasks_for(prefixes.sparkSession, rows, 2_000_000), "shingle", "part").mapInArrow(run, "kind int, a long, b long")


def _bucket_edges(rows: DataFrame, percent: int, n_members: int) -> DataFrame:
    """rows: bucket, key, n, vector of buckets of bounded size. Edges of a forest of each bucket."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in frames if len(b)]
        if not found:
            return
        table = pa.Table.from_batches(found)
        bucket, key = (np.asarray(table.column(c).combine_chunks()) for c in ("bucket", "key"))
        n = np.asarray(table.column("n").combine_chunks())
        points = [point(x) for x in table.column("vector").to_pylist()]
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]]))
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 1:
                rows_ = order[lo:hi]
                forest = candidate_forest([points[r] for r in rows_], n[rows_], percent)
                for i in range(hi - lo):
                    if forest.find(i) != i:
                        a.append(key[rows_[i]])
                        b.append(key[rows_[forest.find(i)]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("bucket", "key", "n", "vector").repartition(tasks_for(rows.sparkSession, n_members, 200_000), "bucket").mapInArrow(run, "a long, b long").where("a <> b")


def _sets_of(docs: DataFrame, wanted: DataFrame, rule: JaccardRule) -> DataFrame:
    """(key, name, members) of the sets whose key is in `wanted`, each once."""
    held = bloom_of(wanted.select(F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("key")), "key")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = may_hold(held.value)
        seen: set[bytes] = set()
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                keys, names, members = [], [], []
                for own in shingle_sets(batch.column("text").slice(lo, hi - lo), rule.k):
                    key, name = digest(own)
                    if len(own) and name not in seen and hit(name[:8]):
                        seen.add(name)
                        keys.append(key)
                        names.append(name)
                        members.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.binary()), pa.array(members, pa.binary())], names=["key", "name", "members"])

    sets = docs.select("text").mapInArrow(run, "key long, name binary, members binary")
    return sets.join(wanted, "key").groupBy("name").agg(F.first("members").alias("members"), F.first("comp").alias("comp"))


def whole_sets(members: list[bytes]) -> list[np.ndarray]:
    """Sets that are kept as their sorted hashes."""
    return [np.frombuffer(m, np.uint64) for m in members]


def _classes(rows: DataFrame, keys: list[str], percent: int, unpack: Callable[[list[bytes]], list[np.ndarray]] = whole_sets, n_rows: int = 0) -> DataFrame:
    """rows: name, class (binary or null), members (what unpack makes sets of), keys, and perhaps side (see across_forest). (keys, name, class):
    the smallest name that is linked inside the rows of equal keys, which come together in one task, one group after the other.
    n_rows: about how many rows there are. Their tasks are many, since the work is far from the bytes' number."""
    types = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)
    sided = "side" in rows.columns
    tasks = tasks_for(rows.sparkSession, n_rows, 50_000)

    def solve(group: list[tuple]) -> pa.RecordBatch:
        group.sort(key=lambda r: r[0])
        sets, known = unpack([r[2] for r in group]), [r[1] for r in group]
        forest = across_forest(sets, [r[-1] for r in group], percent, known) if sided else exact_forest(sets, percent, known)
        names = [r[0] for r in group]
        arrays = [pa.array([r[3 + i] for r in group], pa.int64()) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.binary()), pa.array([names[forest.find(i)] for i in range(len(group))], pa.binary())], names=[*keys, "name", "class"])

    wanted = ["name", "class", "members", *keys, *["side"] * sided]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in frames:
            columns = [batch.column(c).to_pylist() for c in wanted]
            for row in zip(*columns, strict=True):
                if group and row[3 : 3 + len(keys)] != group[0][3 : 3 + len(keys)]:
                    yield solve(group)
                    group = []
                group.append(row)
        if group:
            yield solve(group)

    return rows.select(*wanted).repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(released(run), f"{types}, name binary, class binary")


def _across(rest: DataFrame, bands: DataFrame, rule: JaccardRule) -> DataFrame:
    """rest: name, class, members, comp, band, tile of components that are still apart. bands: rows, bytes and tiles of each
    comp and band. Adds pair and side: a row for each pair of blocks in which a set has to be compared. A block is
    some tiles of a band, of up to `block_sets` sets; blocks of equal and neighbouring bands may hold links."""
    each = F.least(F.lit(rule.block_sets) / (F.col("rows") / F.col("tiles")), F.lit(rule.tile_bytes // 8) / (F.col("bytes") / F.col("tiles")))
    blocked = bands.select("comp", "band", F.greatest(F.floor(each), F.lit(1)).cast("long").alias("each"), F.col("tiles"))
    tiles = rest.select("comp", "band", "tile").distinct().join(blocked, ["comp", "band"]).withColumn("block", F.floor(F.col("tile") / F.col("each")))
    tiles = written(tiles.select("comp", "band", "tile", "block", "tiles"), "tiles")
    blocks = tiles.select("comp", "band", "block", "tiles").distinct()
    first = blocks.select("comp", F.col("band").alias("band_a"), F.col("block").alias("block_a"), "tiles")
    second = blocks.select("comp", F.col("band").alias("band_b"), F.col("block").alias("block_b"))
    near = F.explode(F.array(F.col("band_a"), F.col("band_a") + 1))
    pairs = first.withColumn("band_b", near).join(second, ["comp", "band_b"]).where("band_a < band_b OR block_a < block_b OR (block_a = block_b AND tiles > 1)")
    pairs = pairs.withColumn("pair", F.xxhash64("band_a", "block_a", "band_b", "block_b"))
    ends = [F.struct(F.lit(i).alias("side"), F.col(f"band_{c}").alias("band"), F.col(f"block_{c}").alias("block")) for i, c in enumerate("ab")]
    own = F.expr("band_a = band_b AND block_a = block_b")
    sides = pairs.select("comp", "pair", F.explode(F.when(own, F.array(ends[0])).otherwise(F.array(*ends))).alias("s")).select("comp", "pair", "s.*")
    return rest.join(sides.join(tiles.drop("tiles"), ["comp", "band", "block"]).drop("block"), ["comp", "band", "tile"])


def _banded(sets: DataFrame, rule: JaccardRule, unpack: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """sets: name, members, comp, lone. Adds band: sets of bands that are not equal or neighbours can't be linked."""
    width = -float(np.log(rule.percent / 100)) * 1.000001  # above the largest distance of linked sets' logarithms
    fields = [(n, t) for n, t in sets.dtypes if n in ("name", "members", "comp", "lone")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            band = [int(np.log(len(x)) // width) for x in unpack(batch.column("members").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band, pa.int64())], names=[*batch.schema.names, "band"])

    return sets.select(*(n for n, _ in fields)).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [*fields, ("band", "long")]))


def verified(sets: DataFrame, rule: JaccardRule, unpack: Callable[[list[bytes]], list[np.ndarray]] = whole_sets) -> DataFrame:
    """(name, label) for the sets (name, members, comp) of candidate components: label is the smallest name linked.

    A component of up to `tile_sets` sets is one tile. A larger one is dealt by bands of sizes, of which only equal or
    neighbouring ones can hold links, and a band in tiles of `tile_sets` sets, `tiles` of them at most unless a tile
    would hold more than `tile_limit` sets or `tile_bytes` bytes.
    """
    total = sets.count()
    size = F.sum(F.octet_length("members")).alias("bytes")
    comps = sets.groupBy("comp").agg(F.count("*").alias("rows"), size).withColumn("lone", (F.col("rows") <= rule.tile_sets) & (F.col("bytes") <= rule.tile_bytes)).drop("bytes")
    marked = written(join_salted(sets, written(comps, "comps"), "comp", "rows", total, F.xxhash64("name")).drop("rows"), "marked")
    lone = marked.where("lone").select("name", "members", "comp", F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("tile"), F.lit(1).cast("long").alias("all_tiles"), "lone")
    banded = _banded(marked.where("NOT lone"), rule, unpack)
    each = banded.groupBy("comp", "band").agg(F.count("*").alias("rows"), size)
    count = F.greatest(F.least(F.lit(rule.tiles), F.col("rows") / rule.tile_sets), F.col("rows") / rule.tile_limit, F.col("bytes") / rule.tile_bytes)
    each = written(each.withColumn("tiles", F.ceil(count).cast("long")), "bands")
    whole = each.groupBy("comp").agg(F.sum("tiles").alias("all_tiles"))
    cells = each.join(whole, "comp").groupBy(F.xxhash64("comp", "band").alias("cell")).agg(F.max("rows").alias("rows"), F.max("tiles").alias("tiles"), F.max("all_tiles").alias("all_tiles"))
    dealt = join_salted(banded.withColumn("cell", F.xxhash64("comp", "band")), written(cells, "cells"), "cell", "rows", total, F.xxhash64("name"))
    tiled = lone.unionByName(dealt.withColumn("tile", F.pmod(F.xxhash64("name", F.lit(7)), "tiles")).select(lone.columns))
    tiled = written(tiled.withColumn("class", F.lit(None).cast("binary")), "tiled")
    inside = written(_classes(tiled, ["comp", "band", "tile"], rule.percent, unpack, total), "inside")
    if tiled.where("NOT lone").isEmpty():
        return inside.select("name", F.col("class").alias("label"))
    large = written(tiled.where("NOT lone").drop("class", "lone").join(inside.select("name", "class"), "name"), "large")
    heads = large.where("name = class")
    part = F.pmod(F.xxhash64("name", F.lit(8)), F.ceil(F.sqrt("all_tiles")).cast("long"))
    # one head for each class of a tile; they meet by parts, and what parts miss is left to the pairs of tiles
    over = _classes(heads.withColumn("part", part).withColumn("class", F.lit(None).cast("binary")), ["comp", "part"], rule.percent, unpack)
    edges = written(large.select(F.col("name").alias("a"), F.col("class").alias("b")).unionByName(over.select(F.col("name").alias("a"), F.col("class").alias("b"))), "links")
    labels = written(connected_components(edges).select(F.col("node").alias("name"), "label"), "joined")
    known = large.drop("class").join(labels, "name", "left").withColumn("class", F.coalesce("label", "name")).drop("label")
    apart = known.groupBy("comp").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("rows")).where("low <> high").select("comp", "rows")
    rest = written(join_salted(known, written(apart, "apart"), "comp", "rows", total, F.xxhash64("name")), "rest")
    across = _classes(_across(rest, each, rule), ["comp", "pair"], rule.percent, unpack)
    edges = edges.unionByName(across.select(F.col("name").alias("a"), F.col("class").alias("b")))
    final = connected_components(edges).select(F.col("node").alias("name"), "label")
    return inside.select("name", "class").join(final, "name", "left").select("name", F.coalesce("label", "class").alias("label"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: JaccardRule = JaccardRule()) -> DataFrame:
    """One row for each document: id_col, n_shingles, component_id (the smallest id reachable by links), label, the
    128-bit name of its class (null without shingles), and digest, a hash of its text."""
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("digest"))
    described = written(_described(docs, rule), "described")
    rows = described.where("n IS NOT NULL")
    sketch = sum_blobs(described.where("n IS NULL").select("vector"), np.add, np.int64)
    if sketch is None:
        return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("label"), "digest")
    n_prefixes = int(sketch[: 1 << rule.sketch_bits].sum()) * (100 - rule.percent) // 100 + rows.count()
    grouped = written(_grouped(_prefixes(docs, sketch, rule), rule.dense, n_prefixes), "grouped")
    members = grouped.where("kind = 0").select(F.col("a").alias("bucket"), F.col("b").alias("key")).distinct()
    stars = grouped.where("kind = 1").select("a", "b")
    heads = grouped.where("kind = 2").select(F.col("a").alias("shingle"), F.col("b").alias("key"))  # at most 64 of a shingle
    stars = stars.unionByName(heads.join(heads.groupBy("shingle").agg(F.min("key").alias("b")), "shingle").select(F.col("key").alias("a"), "b"))
    sets = rows.where("n > 0").groupBy("key").agg(F.min("name").alias("least"), F.max("name").alias("most"), F.first("n").alias("n"), F.first("vector").alias("vector"))
    small = members.join(sets.where("least = most"), "key")
    # two sets with one 64-bit key can't be told apart by the bounds: they count as connected to all of their buckets
    double = written(sets.where("least <> most").select("key"), "double")
    lows = members.join(members.join(double, "key", "left_semi").select("bucket").distinct(), "bucket", "left_semi").groupBy("bucket").agg(F.min("key").alias("b"))
    doubled = members.join(double, "key", "left_semi").join(lows, "bucket").select(F.col("key").alias("a"), "b")
    same = double.select(F.col("key").alias("a"), (F.col("key") + 0).alias("b"))
    edges = _bucket_edges(small, rule.percent, grouped.where("kind = 0").count()).unionByName(stars.where("a <> b")).unionByName(doubled.where("a <> b"))
    comps = connected_components(edges).select(F.col("node").alias("key"), F.col("label").alias("comp"))
    comps = written(comps.unionByName(same.join(comps, same["a"] == comps["key"], "left_anti").select(F.col("a").alias("key"), F.col("b").alias("comp"))), "comps")
    if comps.isEmpty():
        labelled = rows.withColumn("label", F.col("name"))
    else:
        labels = written(verified(written(_sets_of(docs, comps, rule), "sets"), rule), "labels")
        counts = rows.groupBy("name").agg(F.count("*").alias("copies")).join(labels, "name")
        labelled = join_salted(rows, counts, "name", "copies", max(1, rows.count()), F.xxhash64("id"), "left").withColumn("label", F.coalesce("label", "name"))
    labelled = written(labelled.select("id", "n", "digest", F.when(F.col("n") > 0, F.col("label")).alias("label")), "labelled")
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("copies"))
    out = join_salted(labelled, least, "label", "copies", max(1, labelled.count()), F.xxhash64("id"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "label", "digest")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: JaccardRule = JaccardRule()) -> DataFrame:
    """docs with one document of each class, that of the smallest id (nulls last); all columns stay.

    Rows that are equal in id and text are one document. Documents without words stay as they are.
    """
    found = similar_classes(docs, id_col, text_col, rule).where("label IS NOT NULL").withColumnRenamed(id_col, "id")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    best = found.groupBy("label").agg(F.min(rank).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    several = join_salted(found.select("label", "id", "digest"), best, "label", "rows", max(1, found.count()), F.xxhash64("id"))
    # what goes (first false) and what is there more than once as the same row (first true)
    doubtful = several.withColumn("first", rank == F.col("best")).groupBy("id", "digest", "first").agg(F.count("*").alias("n")).where("NOT first OR n > 1")
    pair = F.unhex(F.lpad(F.hex(F.xxhash64("id", "digest")), 16, "0"))
    doubtful = written(doubtful.select(F.col("id").alias("_id"), F.col("digest").alias("_other"), "first", pair.alias("_pair")), "doubtful")
    held = bloom_of(doubtful, "_pair")

    @F.pandas_udf("boolean")
    def listed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hit = may_hold(held.value)
        for part in parts:
            yield pd.Series([hit(x) for x in part], dtype=bool)

    # texts are shuffled only where the filter says that a row may be listed
    digest, maybe = fresh_name(docs, "_digest"), fresh_name(docs, "_maybe")
    own_id, names_id, names_digest = fresh_name(docs, "_id"), fresh_name(docs, "_names_id"), fresh_name(docs, "_names_digest")
    doubtful = doubtful.select(F.col("_id").alias(names_id), F.col("_other").alias(names_digest), "first")
    marked = docs.withColumns({digest: F.xxhash64(docs[text_col]), own_id: docs[id_col]}).withColumn(maybe, listed(F.unhex(F.lpad(F.hex(F.xxhash64(id_col, digest)), 16, "0"))))
    some = marked.where(F.col(maybe))
    on = lambda names: some[own_id].eqNullSafe(names[names_id]) & (some[digest] == names[names_digest])
    firsts = doubtful.where("first")
    out = marked.where(~F.col(maybe)).unionByName(some.join(doubtful, on(doubtful), "left_anti")).unionByName(some.join(firsts, on(firsts), "left_semi").dropDuplicates([own_id, digest]))
    return out.drop(digest, own_id, maybe)
