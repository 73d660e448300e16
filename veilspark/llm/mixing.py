"""Operator 10: mixing sources to target weights by Sainte-Lague apportionment.

The mix has as many words as the corpus. They go one by one to the source with the highest quotient
target / (2 * words + 1); consecutive awards fill the shards, so that every shard has integer quotas by source, which
add up to what a source gives. A source's documents are laid end to end in a seeded order; quotas beyond the source's
size repeat it whole, and the rest is met by a seeded, evenly spread choice of its blocks, the last of which is cut at
the word that meets the quota. What is taken, in that order, fills the shards' quotas one after the other, so that
every taken word has a shard. A source smaller than a block is one block, so that quotas are met to the word at every
size of the corpus.

Defined results: a null source is a source of its own, after all others; a null or empty text has size 0 and is
taken 0 times; an empty table gives an empty result. Rows that are equal in id and text are interchangeable.
Other columns, null or clashing in name, are not read. The driver holds one row for each source; up to 100,000 of them
are broadcast, more are joined.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.runtime import batches, buckets, fresh_name, running_sum, written
from veilspark.llm.textbytes import Chunk


@dataclass(frozen=True)
class MixPlan:
    """weights go to the sources in order, again and again; no source gives more than most_repeats times its size.
    blocks: the number of blocks that the corpus is cut into for the choice, at most, and one more for each source; it
    bounds the work of the driver. Quotas don't hang on it."""

    weights: tuple[int, ...] = (5, 2, 1)
    most_repeats: int = 3
    blocks: int = 1 << 16
    shards: int = 16
    seed: int = 17


def targets(sizes: list[int], weights: list[float], most_repeats: int) -> list[float]:
    """Shares of sum(sizes) by weight; a source stops at most_repeats times its size and the excess goes to the others."""
    total = float(sum(sizes))
    out: dict[int, float] = {}
    open_ = set(range(len(sizes)))
    while open_:
        rest, weight = total - sum(out.values()), sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / weight > most_repeats * sizes[i]}
        if not over:
            out |= {i: rest * weights[i] / weight for i in open_}
            break
        out |= {i: float(most_repeats * sizes[i]) for i in over}
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def sainte_lague(votes: list[float], seats: int, shards: int) -> list[list[int]]:
    """Quotas by shard and source: seats go to the highest quotients, ties to the earlier source.

    What one quotient awards at least is taken at once; only the last few seats of a shard are awarded one by one.
    """
    given = [i for i, v in enumerate(votes) if v > 0]
    total = sum(votes[i] for i in given)
    quotas = [[0] * len(votes) for _ in range(shards)]
    had = [0] * len(votes)
    for shard in range(shards if given else 0):
        before, goal = had[:], -(-(shard + 1) * seats // shards)
        if goal > len(given):
            # the awards down to this quotient are no more than goal; one less for each source, for rounding
            least = total / (2 * goal - len(given))
            for i in given:
                had[i] = max(had[i], int((votes[i] / least + 1) / 2) - 1)
        heap = [(-votes[i] / (2 * had[i] + 1), i) for i in given]
        heapq.heapify(heap)
        for _ in range(goal - sum(had)):
            _, i = heap[0]
            had[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * had[i] + 1), i))
        quotas[shard] = [h - b for h, b in zip(had, before)]
    return quotas


def chosen_blocks(size: int, rest: int, block: int, seed: int) -> tuple[int, int, int, int]:
    """n_blocks, picked, offset and cut of a choice of `rest` of `size` words: block b is chosen where
    (b * picked + offset) div n_blocks steps up, and words from cut on are not taken."""
    n = max(1, -(-size // block))
    offset = seed % n
    if not rest:
        return n, 0, offset, 0
    picked = -(-rest // block)
    short = n * block - size if ((n - 1) * picked + offset) // n < picked else 0
    if picked * block - short < rest:
        picked += 1
    full = (rest - 1) // block
    last = -(-((full + 1) * n - offset) // picked) - 1
    return n, picked, offset, last * block + rest - full * block


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Narrow rows: id, source, the number of words and a hash of the text."""
    kinds = dict(docs.dtypes)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                chunk = Chunk(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source"), pa.array(np.diff(chunk.words()[2]).astype(np.int64)), part.column("text_hash")], names=["id", "source", "size", "text_hash"])

    return docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash")).mapInArrow(run, f"id {kinds[id_col]}, source string, size long, text_hash long")


def order_of(id_col: str, text_hash: str, seed: int) -> Column:
    """The seeded order of documents, from 0 to 2 ** 63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(id_col, text_hash, F.lit(seed)), 1)


def _laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, plan: MixPlan) -> tuple[DataFrame, list[tuple], list[list[int]], int]:
    """Documents with the words before them in their source, the sources (key, source, size, target, whole, n_blocks,
    picked, offset, rest, cut), quotas by shard and source in words, and the words of a block."""
    rows = written(sized(docs, id_col, text_col, source_col).withColumn("key", source_key(F.col("source"))), "sized")
    #: One row for each source: what a mix by source has to hold on the driver.
    found = sorted(rows.groupBy("key", "source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    total = sum(sizes)
    goal = targets(sizes, [float(plan.weights[i % len(plan.weights)]) for i in range(len(sizes))], plan.most_repeats)
    block = max(1, -(-total // plan.blocks))
    quotas = sainte_lague(goal, total, plan.shards)
    laid = []
    for i, r in enumerate(found):
        words = min(sum(q[i] for q in quotas), plan.most_repeats * r["size"])
        whole = words // max(1, r["size"])
        rest = words - whole * r["size"]
        n_blocks, picked, offset, cut = chosen_blocks(r["size"], rest, block, int.from_bytes(hashlib.sha256(f"{plan.seed}:{r.key}".encode()).digest()[:8], "big"))
        laid.append((r.key, r.source, r["size"], goal[i], whole, n_blocks, picked, offset, rest, cut))
    bits = max(9, (buckets(sum(r.n for r in found)) - 1).bit_length())
    ordered = rows.withColumn("order", order_of("id", "text_hash", plan.seed))
    placed = running_sum(ordered, ["key"], F.shiftright("order", 63 - bits), [F.col("order"), F.col("id"), F.col("text_hash")], F.col("size"), "before")
    return placed, laid, quotas, block


def source_key(source: Column) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", plan: MixPlan = MixPlan()) -> tuple[DataFrame, DataFrame]:
    """One row for each document (id_col, text_hash, source, size, source_size, target, taken, and by_shard, the words
    taken for each shard that takes any), and the quotas in words: one row for each shard and source."""
    spark = docs.sparkSession
    placed, laid, quotas, block = _laid(docs, id_col, text_col, source_col, plan)
    ends = np.cumsum(np.array(quotas, np.int64).reshape(plan.shards, -1), axis=0)
    by_source = spark.createDataFrame([(k, name, *rest, [0, *ends[:, i].tolist()]) for i, (k, name, *rest) in enumerate(laid)], "key string, name string, source_size long, target double, whole long, n_blocks long, picked long, offset long, rest long, cut long, ends array<long>")
    shares = by_source.select(F.col("name").alias("source"), F.posexplode(F.expr("transform(sequence(1, size(ends) - 1), s -> ends[s] - ends[s - 1])")).alias("shard", "quota")).select("shard", "source", "quota")
    by_source = by_source.drop("name")
    if len(laid) <= 100_000:
        by_source = F.broadcast(by_source)
    placed = placed.join(by_source, "key")

    def picked_before(at: str) -> Column:
        full = f"(({at}) div {block})"
        count = f"(({full} * picked + offset) div n_blocks)"
        following = f"((({full} + 1) * picked + offset) div n_blocks)"
        return F.expr(f"LEAST(rest, {count} * {block} + IF({following} > {count}, ({at}) % {block}, 0))")

    # a document's words stand once in each whole repetition of its source, and as far as its blocks are picked in the rest
    spans = F.expr("transform(sequence(0, whole), c -> struct(c * source_size + before AS lo, c * source_size + before + size AS hi))")
    spans = F.concat(F.slice(spans, F.lit(1), F.col("whole").cast("int")), F.array(F.struct((F.col("whole") * F.col("source_size") + picked_before("before")).alias("lo"), (F.col("whole") * F.col("source_size") + picked_before("before + size")).alias("hi"))))
    dealt = "transform(sequence(1, size(ends) - 1), s -> struct(s - 1 AS shard, aggregate(spans, 0L, (n, x) -> n + greatest(0L, least(x.hi, ends[s]) - greatest(x.lo, ends[s - 1]))) AS words))"
    placed = placed.withColumn("spans", spans).withColumn("by_shard", F.expr(f"filter({dealt}, d -> d.words > 0)"))
    taken = F.expr("aggregate(spans, 0L, (n, x) -> n + x.hi - x.lo)")
    per_doc = placed.select(F.col("id").alias(id_col), "text_hash", "source", "size", "source_size", "target", taken.alias("taken"), "by_shard")
    return per_doc, shares


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", plan: MixPlan = MixPlan()) -> DataFrame:
    """docs as whole documents: each as often as its source is repeated whole, and once more if the block in which it
    starts is picked and the word at which it starts is before the cut; all columns stay. No text is shuffled: a block is a range of the seeded order, and the ranges
    (at most plan.blocks, and two for each source) go to all tasks. Rows equal in id and text share a decision."""
    placed, laid, _, block = _laid(docs, id_col, text_col, source_col, plan)
    cuts = docs.sparkSession.createDataFrame([(key, cut) for key, *_, cut in laid], "key string, cut long")
    if len(laid) <= 100_000:
        cuts = F.broadcast(cuts)
    starts = placed.where("size > 0").join(cuts, "key").groupBy("key", F.expr(f"before div {block}").alias("block"), F.expr("before >= cut").alias("past")).agg(F.min("order").alias("first")).collect()
    found: dict[str, list] = {}
    for r in starts:
        found.setdefault(r["key"], []).append((r["first"], r["block"], r["past"]))
    ranges: dict[str, tuple] = {}
    for key, _, _, _, whole, n_blocks, picked, offset, _, _ in laid:
        own = sorted(found.get(key, []))
        chosen = [not past and (b + 1) * picked + offset >= (b * picked + offset) // n_blocks * n_blocks + n_blocks for _, b, past in own]
        ranges[key] = (whole, np.array([f for f, *_ in own], np.int64), np.array(chosen, bool))
    held = docs.sparkSession.sparkContext.broadcast(ranges)

    @F.pandas_udf("int")
    def copies(keys: pd.Series, orders: pd.Series, words: pd.Series) -> pd.Series:
        out = np.zeros(len(keys), np.int32)
        for key, at in keys.groupby(keys).indices.items():
            whole, first, chosen = held.value[key]
            block_of = np.searchsorted(first, orders.to_numpy()[at], "right") - 1
            out[at] = whole + (chosen[block_of] if len(first) else 0)
        return pd.Series(np.where(words.to_numpy(), out, 0))

    worded = F.coalesce(docs[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key, digest, n, copy = (fresh_name(docs, c) for c in ("_key", "_hash", "_copies", "_copy"))
    marked = docs.withColumn(key, source_key(docs[source_col].cast("string"))).withColumn(digest, F.xxhash64(docs[text_col]))
    counted = marked.withColumn(n, copies(F.col(key), order_of(id_col, digest, plan.seed), worded))
    return counted.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(key, digest, n, copy)
