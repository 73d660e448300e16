"""Operator 3: secret scans with corpus-wide ownership frequency.

Base kinds (assign, access, hex) are always reported. Wider candidate kinds (provider tokens, opaque mixed
strings) are reported only when the corpus says that they look live: the value's hash is aggregated by distinct
repositories and owners, and a value seen under many owners, or in many repositories, is a copied example,
while one that stays with few is owner-specific. The same verdict marks the values of base spans.

Defined results: a null text counts as empty; a null owner is an owner of its own; a null or repeated id is an
ordinary row, and one repository with the rows of the same id (the table names no other). Equal values in one
document are spans of their own. Other columns are not read. Offsets are code points, ends exclusive. An empty table
gives empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.runtime import batches, join_salted, written

#: Fixed values of the contract: kinds in order, with the least length.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE_KINDS = ("assign", "access", "hex")
#: Cheap conditions without which a kind has no span (linear-time engine, over whole columns).
SCREENS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "wide": r"[A-Za-z0-9_-]{15}"}

#: Wider kinds of this operator: form of a provider's token, then any opaque string.
WIDE = (
    ("provider", re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)")),
    ("opaque", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")),
)
KINDS = BASE_KINDS + tuple(k for k, _ in WIDE)
#: Bits for each character that an opaque string has at least.
ENTROPY = 3.0


@dataclass(frozen=True)
class Ownership:
    """A value is owner-specific while it has at most so many distinct owners and repositories."""

    most_owners: int = 2
    most_repositories: int = 8


def base_spans(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, by start and then kind."""
    out = []
    if kinds[0]:
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if kinds[1]:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if kinds[2]:
        out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def wide_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the wider kinds that meet no base span or earlier kind."""
    out: list[tuple[int, int, int, str]] = []
    taken = bytearray(len(text))
    for s, _, e, _ in base:
        taken[s:e] = b"\1" * (e - s)
    for k, (name, pattern) in enumerate(WIDE, len(BASE_KINDS)):
        for m in pattern.finditer(text):
            s, e = m.span()
            if taken.find(1, s, e) < 0 and (name == "provider" or entropy(m.group()) >= ENTROPY):
                taken[s:e] = b"\1" * (e - s)
                out.append((s, k, e, m.group()))
    return out


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))


_SPAN = "struct<start:int,kind:int,end:int,value_hash:binary>"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Narrow rows: id, owner, counts of base kinds, base_sha256, and all candidate spans with hashed values."""
    kinds = dict(docs.dtypes)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                column = pc.fill_null(part.column("text"), "")
                screens = {k: np.asarray(pc.match_substring_regex(column, p)) for k, p in SCREENS.items()}
                counts = np.zeros((3, len(column)), np.int64)
                digests, found = [], []
                for i in range(len(column)):
                    base: list[tuple[int, int, int, str]] = []
                    wide: list[tuple[int, int, int, str]] = []
                    if any(s[i] for s in screens.values()):
                        text = column[i].as_py()
                        base = base_spans(text, tuple(bool(screens[k][i]) for k in BASE_KINDS))
                        wide = wide_spans(text, base) if screens["wide"][i] else []
                    for _, k, _, _ in base:
                        counts[k, i] += 1
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    found.append([{"start": s, "kind": k, "end": e, "value_hash": xxhash.xxh3_128_digest(v)} for s, k, e, v in sorted(base + wide)])
                span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value_hash", pa.binary())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("owner"), *(pa.array(c) for c in counts), pa.array(digests), pa.array(found, span)], names=["id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return docs.select(docs[id_col].alias("id"), docs[owner_col].cast("string").alias("owner"), docs[text_col].alias("text")).mapInArrow(run, f"id {kinds[id_col]}, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<{_SPAN}>")


def ownership(found: DataFrame, rule: Ownership) -> DataFrame:
    """One row for each value: owners, repositories, spans (how often it stands anywhere), live. Distinct counts without
    meeting at one key: first over (value, owner, repository), then partial sums."""
    seen = found.select(F.explode("found").alias("s"), "owner", "id").groupBy(F.col("s.value_hash").alias("value_hash"), "owner", "id").agg(F.count("*").alias("spans"))
    by_owner = seen.groupBy("value_hash", "owner").agg(F.count("*").alias("n"), F.sum("spans").alias("spans"))
    counted = by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.sum("spans").alias("spans"))
    return counted.withColumn("live", (F.col("owners") <= rule.most_owners) & (F.col("repositories") <= rule.most_repositories))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", rule: Ownership = Ownership()) -> tuple[DataFrame, DataFrame]:
    """One row for each document (id_col, owner, counts, base_sha256, spans as structs with verdicts, and joined as
    text), and the ownership of each value."""
    rows = written(candidates(docs, id_col, text_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    owned = written(ownership(rows, rule), "ownership")
    spans = rows.select("row", F.explode("found").alias("s")).select("row", "s.*")
    total = owned.agg(F.sum("spans")).first()[0] or 0
    judged = join_salted(spans, owned.select("value_hash", "live", F.col("spans").alias("times")), "value_hash", "times", total, F.xxhash64("row", "start")).where(F.col("live") | (F.col("kind") < len(BASE_KINDS)))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("verdicts"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("verdicts", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = rows.drop("found").join(per_row, "row", "left").drop("row").withColumn("spans", F.coalesce(text, F.lit(""))).withColumn("n_live", F.coalesce(F.size(F.filter("verdicts", lambda s: s["live"])), F.lit(0)))
    return out.withColumnRenamed("id", id_col), owned
