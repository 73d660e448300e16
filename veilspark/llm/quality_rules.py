"""Operator 1: quality classifier as a sparse ensemble of rules.

Shallow trees are boosted over statistics of labelled texts; every path from a root to a node is a conjunctive
rule; logistic weights of the rules are fitted under a lasso penalty, which leaves few; those are compiled into
one Spark column expression over the statistics. The model is fitted on the driver, on at most `max_rows`
labelled rows in expectation (chosen by a hash of the id); everything else runs over all rows.

Defined results: a null or empty text has all statistics 0 and is scored like any other; labels that are null are
not used, an id with several labels counts by their mean; with no label, or labels of one class only, every score
is the share of good labels (0.5 without any). Other columns, null or clashing in name, are not read. A score
depends on the text alone, so repeated rows have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.runtime import batches, fresh_name, named
from veilspark.llm.textbytes import SPACE, Chunk

STATISTICS = ("log_chars", "log_words", "word_len", "upper", "digit", "symbol", "bar", "shout_mark", "stop_mark", "symbol_words", "distinct_words", "top_word", "repeat_pairs", "line_words", "dup_lines", "wide", "blank")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_SYMBOL, _BAR, _SHOUT, _STOP = _class(b"#*$%&<>=~^_\\{}[]@+"), _class(b"|"), _class(b"!"), _class(b".?")


def statistics(chunk: Chunk) -> np.ndarray:
    """One row for each text, one column for each of STATISTICS."""
    data = chunk.data
    n = chunk.n
    starts, ends, first = chunk.words()
    n_words = np.diff(first)
    n_chars = chunk.per_text((data & 0xC0) != 0x80)
    some = np.maximum(n_chars, 1)
    words = np.maximum(n_words, 1)
    share = lambda table: chunk.per_text(table[data]) / some
    marks = np.concatenate([[0], np.cumsum((_SYMBOL | _BAR)[data], dtype=np.int64)])
    marked = np.concatenate([[0], np.cumsum(marks[ends] > marks[starts], dtype=np.int64)])
    hashes = chunk.span_hash(starts, ends)
    distinct, top, pairs, dup_lines, lines = (np.zeros(n) for _ in range(5))
    for i in range(n):
        own = hashes[first[i] : first[i + 1]]
        if len(own):
            ranked = np.sort(own)
            runs = np.diff(np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])))
            distinct[i], top[i] = len(runs) / len(own), runs.max() / len(own)
            if len(own) > 1:
                two = np.sort(own[1:] * np.uint64(3) + own[:-1])
                pairs[i] = np.count_nonzero(two[1:] == two[:-1]) / len(two)
        own_lines = [x for x in chunk.text(i).split(b"\n") if x.strip()]
        lines[i] = len(own_lines)
        dup_lines[i] = 1 - len(set(own_lines)) / max(1, len(own_lines))
    return np.column_stack([
        np.log1p(n_chars), np.log1p(n_words), chunk.per_text(~SPACE[data] & ((data & 0xC0) != 0x80)) / words,
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_BAR), share(_SHOUT), share(_STOP),
        (marked[first[1:]] - marked[first[:-1]]) / words, distinct, top, pairs, n_words / np.maximum(lines, 1), dup_lines,
        chunk.per_text(data >= 0xC0) / some, chunk.per_text(SPACE[data]) / some,
    ])


def with_statistics(docs: DataFrame, text_col: str, keep: list[str], out: str = "statistics") -> DataFrame:
    """The columns `keep` and `out`, a struct of the statistics of each row's whole text."""
    chosen = docs.select(*[docs[named(c)] for c in keep], docs[named(text_col)]).toDF(*(f"c{i}" for i in range(len(keep))), "text")  # columns may have any names

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                stats = statistics(Chunk(part.column("text")))
                packed = pa.StructArray.from_arrays([pa.array(stats[:, j]) for j in range(stats.shape[1])], names=list(STATISTICS))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], names=[*part.schema.names[:-1], "packed"])

    schema = [f"{c} {t}" for c, t in chosen.dtypes[:-1]] + [f"packed struct<{', '.join(f'{s}: double' for s in STATISTICS)}>"]
    return chosen.mapInArrow(run, ", ".join(schema)).toDF(*keep, out)


Condition = tuple[str, bool, float]  # statistic, whether it has to be over the value, value


@dataclass(frozen=True)
class RuleModel:
    """sigmoid(bias + the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...] = field(default=())

    def column(self, of: str = "statistics") -> Column:
        """The score as a Spark expression over the fields of a struct of STATISTICS."""
        terms = [f"{float(self.bias)!r}D"]
        for conditions, weight in self.rules:
            held = " AND ".join(f"`{of}`.`{s}` {'>' if over else '<='} {float(v)!r}D" for s, over, v in conditions)
            terms.append(f"(CASE WHEN {held} THEN {float(weight)!r}D ELSE 0D END)")
        return F.expr(f"1D / (1D + exp(-greatest(-500D, least(500D, {' + '.join(terms)}))))")

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The same in numpy, for tests."""
        total = np.full(len(stats), self.bias)
        for conditions, weight in self.rules:
            total += weight * _holds(stats, conditions)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _holds(stats: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    held = np.ones(len(stats), bool)
    for s, over, value in conditions:
        x = stats[:, STATISTICS.index(s)]
        held &= x > value if over else x <= value
    return held


def tree_paths(stats: np.ndarray, good: np.ndarray, trees: int, depth: int, bins: int, seed: int) -> list[tuple[Condition, ...]]:
    """Paths of trees boosted on the logistic loss, each over a seeded half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(stats[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(stats.shape[1])]
    binned = np.column_stack([np.searchsorted(c, stats[:, j], "left") for j, c in enumerate(cuts)])
    margin = np.full(len(good), np.log(good.mean() / (1 - good.mean())))
    paths: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = good - p, p * (1 - p) + 1e-6
        drawn = rng.random(len(good)) < 0.5

        def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
            own = rows[drawn[rows]]
            if path:
                paths.setdefault(tuple(sorted(path)))
            best = (1e-3, None, 0)
            if len(path) < depth and len(own) >= 20:
                g, h = gradient[own], hessian[own]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for j, c in enumerate(cuts):
                    if len(c):
                        gs, hs = (np.cumsum(np.bincount(binned[own, j], w, len(c) + 1))[:-1] for w in (g, h))
                        n = np.cumsum(np.bincount(binned[own, j], minlength=len(c) + 1))[:-1]
                        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                        gain[(n < 10) | (len(own) - n < 10)] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), j, int(gain.argmax()))
            if best[1] is None:
                margin[rows] += 0.3 * gradient[own].sum() / (hessian[own].sum() + 1) if len(own) else 0
                return
            _, j, k = best
            name, value = STATISTICS[j], float(cuts[j][k])
            under = binned[rows, j] <= k
            grow(rows[under], path + ((name, False, value),))
            grow(rows[~under], path + ((name, True, value),))

        grow(np.arange(len(good)), ())
    return list(paths)


def lasso_logistic(x: np.ndarray, good: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps; the bias bears no penalty."""
    n, m = x.shape
    x = np.hstack([x, np.ones((n, 1), x.dtype)])
    vector = np.ones(m + 1, x.dtype)
    for _ in range(20):
        vector = x.T @ (x @ vector)
        vector /= np.linalg.norm(vector)
    step = 4 * n / float(np.linalg.norm(x.T @ (x @ vector)))
    w = np.zeros(m + 1)
    w[m] = np.log(good.mean() / (1 - good.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ ahead.astype(x.dtype))))
        moved = ahead - step * (x.T @ (p - good).astype(x.dtype)) / n
        moved[:m] = np.sign(moved[:m]) * np.maximum(np.abs(moved[:m]) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = moved + (t - 1) / faster * (moved - w), moved, faster
    return float(w[m]), w[:m]


def fit_rules(stats: np.ndarray, good: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, penalty: float = 1e-3, seed: int = 7) -> RuleModel:
    """The model for a sample in memory. All paths go to the lasso, one of those that hold for the same rows:
    trees * (2 ** (depth + 1) - 2) at most."""
    good = good.astype(np.float64)
    if not len(good) or good.min() == good.max():
        mean = float(good.mean()) if len(good) else 0.5
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return RuleModel(float(np.log(mean / (1 - mean))))
    order = np.lexsort((good, *stats.T))  # so that the order of arrival has no effect
    stats, good = stats[order], good[order]
    paths = tree_paths(stats, good, trees, depth, bins, seed)
    held: dict[bytes, tuple[tuple[Condition, ...], np.ndarray]] = {}
    for path in paths:
        on = _holds(stats, path)
        if 0 < on.sum() < len(on):
            held.setdefault(np.packbits(on).tobytes(), (path, on))
    kept = list(held.values())
    if not kept:
        return RuleModel(float(np.log(good.mean() / (1 - good.mean()))))
    bias, weights = lasso_logistic(np.column_stack([on for _, on in kept]).astype(np.float32), good, penalty)
    return RuleModel(bias, tuple((path, float(w)) for (path, _), w in zip(kept, weights, strict=True) if abs(w) > 1e-9))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int, learn: Column | None = None) -> DataFrame:
    """About max_rows ids at most, with good = 1 if the mean of an id's labels is 0.5 or more; the same ids in every run."""
    one = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    if learn is not None:
        one = one.where(learn)
    one = one.groupBy("id").agg(F.when(F.avg("label") >= 0.5, 1).otherwise(0).alias("good"))
    n = one.count()
    space = 1 << 30
    return one.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(space)) < int(space * min(1.0, max_rows / max(n, 1))))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 12_000, learn: Column | None = None) -> RuleModel:
    """Fits on about max_rows labelled documents at most. learn: a condition on the column `id` of labels."""
    sample = labelled_sample(labels, id_col, label_col, max_rows, learn)  # two narrow columns of max_rows rows: small enough to broadcast at any size of the corpus
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(sample), "id")
    stats = with_statistics(picked, "text", ["id"]).groupBy("id").agg(F.min("statistics").alias("s")).join(F.broadcast(sample), "id").select("good", "s.*").toPandas()
    return fit_rules(stats[list(STATISTICS)].to_numpy(np.float64), stats["good"].to_numpy())


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each document: id_col, score, predicted (1 from the threshold on) and the statistics."""
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    scored = with_statistics(narrow, "text", ["id"]).withColumn("score", model.column())
    return scored.select(F.col("id").alias(id_col), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "statistics.*")


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with a score from the threshold on; all columns stay."""
    out = fresh_name(docs, "_statistics")
    return with_statistics(docs, text_col, docs.columns, out).where(model.column(out) >= threshold).drop(out)
