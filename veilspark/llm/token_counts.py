"""Operator 4: token counts with offset-mapped attribution.

A whole document is encoded once; the byte spans of its tokens are mapped to code points and joined as intervals
with the spans of its sections. A token that crosses a boundary goes by an explicit rule: `start` (the section of
its first code point), `majority` (the section with most of its bytes, the earlier one on ties) or `split` (by
bytes, in parts that sum to one token).

Sections are lines by default (a line ends after its line feed), or spans from a column array<struct<name:string,
start:int,end:int>> in code points that neither overlap nor go beyond the text; what no span covers goes to the
section named null. Defined results: a null or empty text gives no section; a null or repeated id is an ordinary
row; an empty table gives an empty result. Other columns, null or clashing in name, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.runtime import batches

#: The split pattern of the 50,257-entry byte-level vocabulary (a fixed value of that tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "split")


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(raw: bytes, pattern: str = PATTERN):  # noqa: ANN201
    """The tokenizer and the byte length of each of its tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by section (float), tokens that begin in a section and cross its end, and tokens that begin in it.

    ends: byte ends of tokens, contiguous from 0. bounds: byte starts of sections and the end of the last, from 0.
    """
    starts = np.concatenate([[0], ends[:-1]])
    n = len(bounds) - 1
    home = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    begun = np.bincount(home, minlength=n)
    crossing = np.flatnonzero(last > home)
    crossed = np.bincount(home[crossing], minlength=n)
    share = begun.astype(np.float64)
    if rule != "start":
        for t in crossing:
            parts = np.minimum(bounds[home[t] + 1 : last[t] + 2], ends[t]) - np.maximum(bounds[home[t] : last[t] + 1], starts[t])
            share[home[t]] -= 1
            if rule == "split":
                share[home[t] : last[t] + 1] += parts / parts.sum()
            else:
                share[home[t] + int(parts.argmax())] += 1
    return share, crossed, begun


def attribute_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "start") -> DataFrame:
    """One row for each document and section: id_col, section (its number), name, start and end in code points,
    n_tokens, n_crossing (tokens that begin in it and end beyond) and doc_tokens (of the whole document)."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    raw = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))  # a vocabulary file, under 1 MB
    columns = [docs[id_col].alias("id"), docs[text_col].alias("text")] + ([docs[sections_col].alias("sections")] if sections_col else [])
    held: dict[str, tuple] = {}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in held:
            held["encoder"] = encoder(raw.value)
        encode, lengths = held["encoder"][0].encode_ordinary, held["encoder"][1]
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text").to_pylist()
                sections = part.column("sections").to_pylist() if sections_col else None
                at, columns_out, names = [], [], []
                for i, text in enumerate(texts):
                    if not text:
                        continue
                    data = np.frombuffer(text.encode("utf-8"), np.uint8)
                    ends = np.cumsum(lengths[encode(text)])
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    if sections is None:
                        cut = np.flatnonzero(data == 10) + 1
                        bounds = np.concatenate([[0], cut[cut < len(data)], [len(data)]])
                        own: list[str | None] = ["line"] * (len(bounds) - 1)
                    else:
                        bounds, own = _bounds(sections[i] or [], np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    share, crossed, _ = attribute(ends, bounds, rule)
                    at += [i] * len(own)
                    names += own
                    columns_out.append(np.column_stack([np.arange(len(own)), chars[bounds[:-1]], chars[bounds[1:]], share, crossed, np.full(len(own), len(ends))]))
                table = np.concatenate(columns_out) if columns_out else np.zeros((0, 6))
                whole = lambda j: pa.array(table[:, j].astype(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), whole(0), pa.array(names, pa.string()), whole(1), whole(2), pa.array(table[:, 3]), whole(4), whole(5)], names=[id_col, "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return docs.select(*columns).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, section long, name string, start long, end long, n_tokens double, n_crossing long, doc_tokens long")


def _bounds(spans: list[dict], byte_of: np.ndarray, n_bytes: int) -> tuple[np.ndarray, list[str | None]]:
    """Byte bounds of given spans and of the gaps between them."""
    byte = lambda c: int(byte_of[c]) if c < len(byte_of) else n_bytes
    bounds, names = [0], []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        start, end = byte(s["start"]), byte(s["end"])
        if start < bounds[-1] or end < start:
            raise ValueError("sections overlap")
        if start > bounds[-1]:
            bounds.append(start)
            names.append(None)
        if end > start:
            bounds.append(end)
            names.append(s["name"])
    if bounds[-1] < n_bytes:
        bounds.append(n_bytes)
        names.append(None)
    return np.array(bounds), names
