"""Operator 5: benchmark decontamination over a BM25 index with block-max WAND.

Test items are cut into segments of at most `segment` words and indexed by term; posting weights are BM25 weights
divided by the segment's score against itself, so that one threshold serves all. Every training passage (windows of
two segments' length, one segment apart, over whole texts) is a query: a passage whose terms' maxima cannot sum to
the threshold is skipped; then blocks of segments whose block maxima cannot; what stays is scored exactly. All
segments at or above the threshold are retrieved, and each item is verified by the share of its question's and its
answer's runs of `shingle` words found around the passage.

The index is built from the items alone. It goes to executors in parts of at most `segments_per_pass` segments, one
pass over the documents for each part. A part has an entry for each posting and block of a term, so that what is
broadcast is a few MB whatever the benchmark's size.

Defined results: a null or empty text matches nothing; an item without words is never found; an item of fewer words
than a shingle is compared as one run; a null or repeated id, of a document or an item, is an ordinary row, and ids
keep their type; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veilspark.llm.runtime import batches, fresh_name
from veilspark.llm.textbytes import PLAIN, Chunk, mix

#: Of a verified item, besides its id.
MATCH = ("score double", "question_overlap double", "answer_overlap double", "overlap double", "first_word bigint")


@dataclass(frozen=True)
class Retrieval:
    """threshold: share of a segment's own score. overlap: share of an item's runs of words. answer_overlap: least
    share of the answer's runs if the whole falls short of `overlap` but the question does not."""

    segment: int = 64
    threshold: float = 0.5
    shingle: int = 5
    overlap: float = 0.8
    answer_overlap: float = 0.5
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    segments_per_pass: int = 4096


def split_answer(text: str, k: int) -> tuple[str, str]:
    """The last sentence is the answer, if it and what stands before have k words at least; else there is none."""
    ends = [m.end() for m in re.finditer(r"[.!?][\"')]?(?=\s)", text.rstrip())]
    for end in reversed(ends):
        if len(text[end:].split()) >= k:
            return (text[:end], text[end:]) if len(text[:end].split()) >= k else (text, "")
    return text, ""


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chunk = Chunk(pa.array(texts, pa.string()), PLAIN, True)
    starts, ends, first = chunk.words()
    return chunk.span_hash(starts, ends), first


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words, one for each start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9DDFEA08EB382D69) + hashes[j : j + n]
    return mix(out)


class Index:
    """Postings of the segments of some items, by term, with maxima by term and by term and block."""

    def __init__(self, items: list[tuple[int, str, str]], rule: Retrieval, df: dict[int, int], n_items: int, mean_words: float):
        self.rule, self.items = rule, []
        segments: list[tuple[int, np.ndarray]] = []
        for item_id, question, answer in items:
            hashes, first = _hashes([question, answer])
            if not len(hashes):
                continue
            k = min(rule.shingle, len(hashes))
            q, a = hashes[: first[1]], hashes[first[1] :]
            self.items.append((item_id, k, np.unique(runs(hashes, k)), np.unique(runs(q, k)), np.unique(runs(a, k)), len(hashes)))
            n = -(-len(hashes) // rule.segment)
            for part in np.array_split(hashes, n):
                segments.append((len(self.items) - 1, part))
        self.item_of = np.array([i for i, _ in segments], np.int64)
        terms, segment_of, weights = [], [], []
        for s, (_, part) in enumerate(segments):
            own, tf = np.unique(part, return_counts=True)
            count = np.array([df[int(t)] for t in own])
            w = np.log(1 + (n_items - count + 0.5) / (count + 0.5)) * tf * (rule.k1 + 1) / (tf + rule.k1 * (1 - rule.b + rule.b * len(part) / mean_words))
            terms.append(own)
            segment_of.append(np.full(len(own), s))
            weights.append(w / w.sum())
        all_terms = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
        self.terms, code = np.unique(all_terms, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.segment_of = (np.concatenate(segment_of) if terms else np.zeros(0, np.int64))[order]
        self.weights = (np.concatenate(weights) if terms else np.zeros(0))[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
        self.n_segments, n_blocks = len(segments), -(-len(segments) // rule.block)
        # a term's postings stand in order of segments: one maximum for each of its blocks, and no more entries than postings
        block_of = self.segment_of // rule.block
        new = np.ones(len(block_of), bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (block_of[1:] != block_of[:-1])
        cuts = np.flatnonzero(new)
        self.n_blocks, self.block_of = n_blocks, block_of[cuts].astype(np.int32)
        self.block_max = np.maximum.reduceat(self.weights, cuts) * (1 + 1e-9) if len(cuts) else np.zeros(0)
        self.block_first = np.searchsorted(code[order][cuts], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.block_max, self.block_first[:-1]) if len(cuts) else np.zeros(0)
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def search(self, chunk: Chunk) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word of the passage, segment, score) of all segments at or above the threshold."""
        size, theta = self.rule.segment, self.rule.threshold
        starts, ends, first = self.words = chunk.words()
        hashes = self.hashes = chunk.span_hash(starts, ends)
        n_words = np.diff(first)
        halves = -(-n_words // size)
        half_first = np.concatenate([[0], np.cumsum(halves)])
        maybe = np.flatnonzero(self.screen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.terms):
            return
        code = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        hit = self.terms[code] == hashes[maybe]
        at, code = maybe[hit], code[hit]
        text = np.searchsorted(first, at, "right") - 1
        key = np.unique((half_first[text] + (at - first[text]) // size) * len(self.terms) + code)
        half, code = key // len(self.terms), key % len(self.terms)
        n_halves = int(half_first[-1])
        own = np.bincount(half, self.term_max[code], n_halves)
        last = np.zeros(n_halves, bool)
        last[half_first[1:][halves > 0] - 1] = True
        single = np.zeros(n_halves, bool)
        single[half_first[:-1][halves == 1]] = True
        bound = own.copy()
        bound[:-1] += np.where(last[:-1], 0, own[1:])
        bound[last & ~single] = 0  # a text's last half stands in the passage before
        live = np.flatnonzero(bound >= theta)
        if not len(live):
            return
        span = np.searchsorted(half, np.arange(n_halves + 1))
        need = np.unique(np.concatenate([live, np.minimum(live + 1, n_halves - 1)]))
        need = need[span[need + 1] > span[need]]
        text_of = np.searchsorted(half_first, live, "right") - 1
        for p, alive in self._blocks(live, last, need, span, code):
            h = live[p]
            own_code = code[span[h] : span[h + (1 if last[h] else 2)]]
            own_code = np.unique(own_code)
            lengths = self.first[own_code + 1] - self.first[own_code]
            take = np.repeat(self.first[own_code] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            segment = self.segment_of[take]
            wanted = alive[segment // self.rule.block]
            scores = np.bincount(segment[wanted], self.weights[take][wanted], self.n_segments)
            for s in np.flatnonzero(scores >= theta - 1e-9):
                yield int(text_of[p]), int((h - half_first[text_of[p]]) * size), int(s), float(scores[s])

    def _blocks(self, live: np.ndarray, last: np.ndarray, need: np.ndarray, span: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(index in live, mask of blocks) of the passages with a block whose maxima can sum to the threshold. Sums are
        taken for lots of half passages, so that a lot's sums by block fit in a few MB at any number of blocks."""
        lot = max(2, (1 << 20) // max(1, self.n_blocks))
        for lo in range(0, len(live), lot):
            own = live[lo : lo + lot]
            halves = need[(need >= own[0]) & (need <= own[-1] + 1)]
            rows = np.concatenate([np.arange(span[h], span[h + 1]) for h in halves]) if len(halves) else np.zeros(0, np.int64)
            at = np.repeat(np.arange(len(halves)), span[halves + 1] - span[halves])
            begin = self.block_first[code[rows]]
            lengths = self.block_first[code[rows] + 1] - begin
            entries = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(rows) else np.zeros(0, np.int64)
            sums = np.bincount(np.repeat(at, lengths) * self.n_blocks + self.block_of[entries], self.block_max[entries], (len(halves) + 1) * self.n_blocks).reshape(-1, self.n_blocks)
            place = np.full(int(own[-1]) + 2 - int(own[0]), len(halves))  # halves without any term have sums of 0
            place[halves - own[0]] = np.arange(len(halves))
            both = sums[place[own - own[0]]] + np.where(last[own], 0, 1)[:, None] * sums[place[own + 1 - own[0]]]
            alive = both >= self.rule.threshold
            for p in np.flatnonzero(alive.any(axis=1)):
                yield lo + int(p), alive[p]

    def matches(self, chunk: Chunk) -> list[list[dict]]:
        """Verified items of each text, the best passage of each."""
        found: list[dict[int, dict]] = [{} for _ in range(chunk.n)]
        for text, word, segment, score in self.search(chunk):
            i = int(self.item_of[segment])
            item_id, k, whole, question, answer, length = self.items[i]
            first = self.words[2]
            around = self.hashes[max(first[text], first[text] + word - length) : min(first[text + 1], first[text] + word + 2 * self.rule.segment + length)]
            have = np.unique(runs(around, k))
            share = lambda part: float(np.isin(part, have).mean()) if len(part) else None  # noqa: B023, E731
            total, q = share(whole), share(question)
            q = total if q is None else q
            a = share(answer)
            a = q if a is None else a
            if total >= self.rule.overlap or q >= self.rule.overlap and a >= self.rule.answer_overlap:
                old = found[text].get(i)
                if old is None or (total, score) > (old["overlap"], old["score"]):
                    found[text][i] = {"item_id": item_id, "score": score, "question_overlap": q, "answer_overlap": a, "overlap": total, "first_word": word}
        return [[f[i] for i in sorted(f)] for f in found]  # in order of the items


def build_indexes(items: DataFrame, rule: Retrieval, item_col: str, text_col: str, answer_col: str | None) -> Iterator[Index]:
    """Indexes of bounded parts of the items, in order of id, with document frequencies over all items."""
    cols = [F.col(item_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("q")] + ([F.coalesce(F.col(answer_col), F.lit("")).alias("a")] if answer_col else [])
    ordered = items.select(*cols).orderBy("id", "q", *(["a"] if answer_col else []))
    df: dict[int, int] = {}
    n_items = n_words = 0
    for r in ordered.toLocalIterator():
        hashes, _ = _hashes([r.q, r.a if answer_col else ""])
        n_items, n_words = n_items + 1, n_words + min(len(hashes), rule.segment)
        for t in np.unique(hashes):
            df[int(t)] = df.get(int(t), 0) + 1
    part: list[tuple[int, str, str]] = []
    held = 0
    for r in ordered.toLocalIterator() if n_items else ():
        part.append((r.id, r.q, r.a) if answer_col else (r.id, *split_answer(r.q, rule.shingle)))
        held += 1 + len(r.q.split()) // rule.segment
        if held >= rule.segments_per_pass:
            yield Index(part, rule, df, n_items, n_words / n_items)
            part, held = [], 0
    if part or not n_items:
        yield Index(part, rule, df, max(n_items, 1), n_words / max(n_items, 1) or 1.0)


def with_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "matches", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, rule: Retrieval = Retrieval()) -> DataFrame:
    """docs with `out`, an array of the test items found in each text, after as many passes as the index has parts."""
    id_type = dict(items.dtypes)[item_col]
    match = f"array<struct<item_id:{id_type}," + ",".join(m.replace(" ", ":") for m in MATCH) + ">>"
    columns = docs.columns
    text = f"c{columns.index(text_col)}"
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))  # columns may have any names
    parts = 0
    for index in build_indexes(items, rule, item_col, item_text_col, answer_col):
        held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))
        schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes) + f", found{parts} {match}"
        docs = docs.mapInArrow(_pass(held, text, f"found{parts}", schema_type(items, item_col)), schema)
        parts += 1
    found = reduce(F.concat, [F.col(f"found{k}") for k in range(parts)])
    return docs.select(*(f"c{i}" for i in range(len(columns))), found).toDF(*columns, out)


def schema_type(items: DataFrame, item_col: str) -> pa.DataType:
    """Of the arrays of matches."""
    kinds = {"double": pa.float64(), "bigint": pa.int64()}
    return pa.list_(pa.struct([("item_id", to_arrow_type(items.schema[item_col].dataType)), *((n, kinds[t]) for n, t in (m.split() for m in MATCH))]))


def _pass(held, text_col: str, out: str, kind: pa.DataType):  # noqa: ANN001, ANN202
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(held.value)
        for batch in frames:
            for lo, hi in batches(batch, text_col):
                part = batch.slice(lo, hi - lo)
                found = index.matches(Chunk(part.column(text_col), PLAIN, True))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*part.schema.names, out])

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:  # noqa: ANN003
    """One row for each document and test item that is verified in it."""
    return with_matches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), items, "text", "matches", **kw).select(F.col("id").alias(id_col), F.inline("matches"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:  # noqa: ANN003
    """docs without those that hold a test item; all columns stay."""
    out = fresh_name(docs, "_matches")
    return with_matches(docs, items, text_col, out, **kw).where(F.size(out) == 0).drop(out)
