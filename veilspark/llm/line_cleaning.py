"""Operator 8: line-first cleaning.

Every line of a text is held against rules (no sentence punctuation, navigation, boilerplate, symbols,
shouting, a repeat of an earlier line). Failing lines go; a document that loses more than `max_loss` of its
word characters, or that fails the base counts, is rejected.

Defined results: a null text counts as empty; an empty text, or one of white space, has no words and so fails
the base; other columns, null or clashing in name, are not read. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.runtime import batches
from veilspark.llm.textbytes import SPACE, Chunk, shingles

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50

BOILERPLATE = re.compile(rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept (?:all )?cookies|javascript (?:is|must be) (?:enabled|disabled)|enable javascript|sign up for our newsletter|subscribe to our|click here to|lorem ipsum|\(c\) ?(?:19|20)\d\d|copyright (?:\xc2\xa9 ?)?(?:19|20)\d\d|licensed under the|permission is hereby granted|without warranties or conditions", re.I)
NAVIGATION = re.compile(rb"(?:home|menu|login|log in|sign in|sign up|register|search|contact(?: us)?|about(?: us)?|next|previous|prev|back to top|share|tweet|print|read more|more|faq|sitemap|help)", re.I)
SENTENCE_END = (b".", b"!", b"?", b"\xe2\x80\xa6", b'."', b'!"', b'?"', b".'", b".)", b"\xe3\x80\x82", b":", b";")
SENTENCE_INSIDE = re.compile(rb"[.!?][\"')]?(?:[\x20\x09-\x0D]|$)|\xe3\x80\x82")
SYMBOL = re.compile(rb"[#*$%&|<>]")
BLANKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    """short_words: a line of fewer words needs sentence punctuation. bar_percent, symbol_percent: words that hold a
    bar or another symbol. shout_percent: capitals among ASCII letters, from shout_letters on. max_loss: percent of
    the word characters that removed lines may hold."""

    short_words: int = 4
    bar_percent: int = 30
    symbol_percent: int = 40
    shout_percent: int = 80
    shout_letters: int = 20
    max_loss: int = 50


def line_fault(line: bytes, rules: LineRules) -> str | None:
    """The first rule that a line with a word fails."""
    words = line.split()
    n = len(words)
    if SYMBOL.search(line):
        if 100 * sum(b"|" in w for w in words) > rules.bar_percent * n:
            return "navigation"
        if 100 * sum(SYMBOL.search(w) is not None for w in words) > rules.symbol_percent * n:
            return "symbols"
    if n <= 6 and NAVIGATION.fullmatch(b" ".join(words)):
        return "navigation"
    if BOILERPLATE.search(line):
        return "boilerplate"
    if n < rules.short_words and not line.strip(BLANKS).endswith(SENTENCE_END) and not SENTENCE_INSIDE.search(line):
        return "punctuation"
    upper = sum(map(line.count, _CAPITALS))
    if upper >= rules.shout_letters // 2:
        letters = upper + sum(map(line.count, _SMALL))
        if letters >= rules.shout_letters and 100 * upper > rules.shout_percent * letters:
            return "shouting"
    return None


_CAPITALS = [bytes([c]) for c in range(65, 91)]
_SMALL = [bytes([c]) for c in range(97, 123)]
FAULTS = ("punctuation", "navigation", "boilerplate", "symbols", "shouting", "repeated")


def clean_lines(text: bytes, rules: LineRules) -> tuple[list[bytes], dict[str, int], int, int]:
    """Kept lines, lines removed by rule, repeated lines with a word, and bytes of words lost (continuation bytes not counted)."""
    seen: set[bytes] = set()
    kept, faults, repeats, lost = [], dict.fromkeys(FAULTS, 0), 0, 0
    for line in text.split(b"\n"):
        if not line.strip(BLANKS):
            kept.append(line)
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        fault = "repeated" if again else line_fault(line, rules)
        if fault:
            faults[fault] += 1
            lost += len(b"".join(line.split()).decode("utf-8", "replace"))
        else:
            kept.append(line)
    return kept, faults, repeats, lost


def repeated_words(hashes: np.ndarray, first: np.ndarray, k: int = 3) -> np.ndarray:
    """For each text the number of words inside a window of k words that is found twice or more in it."""
    rolled, offsets = shingles(hashes, first, k)
    n_words = np.diff(first)
    out = np.zeros(len(n_words), np.int64)
    for i in np.flatnonzero(n_words > k):
        own = rolled[offsets[i] : offsets[i + 1]]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(n_words[i] + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
        out[i] = np.count_nonzero(np.cumsum(cover[:-1]))
    return out


def line_first_cleaning(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row for each document: the base counts, lines removed by each rule, the percent of word characters
    lost, base_failed, kept and, if asked for, the cleaned text (null where the text is)."""
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, " + ", ".join(f"lines_{f} long" for f in FAULTS) + ", lost_percent double" + (", cleaned string" if with_text else "")
    id_type = dict(docs.dtypes)[id_col]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                chunk = Chunk(part.column("text"))
                starts, ends, first = chunk.words()
                n_words = np.diff(first)
                inside = ~SPACE[chunk.data]
                chars = chunk.per_text(inside & ((chunk.data & 0xC0) != 0x80))
                symbols = chunk.per_text(np.isin(chunk.data, np.frombuffer(SYMBOLS, np.uint8)))
                repeats = repeated_words(chunk.span_hash(starts, ends), first)
                base = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
                null = part.column("text").is_null().to_pylist()
                dup, lost, lines, faults, cleaned = [], [], [], [], []
                for i in range(chunk.n):
                    kept, failed, again, gone = clean_lines(chunk.text(i), rules)
                    dup.append(again)
                    lost.append(gone)
                    faults.append(failed)
                    lines.append(len(kept) + sum(failed.values()))
                    if with_text:
                        cleaned.append(None if null[i] else b"\n".join(kept).decode("utf-8", "replace"))
                share = 100.0 * np.array(lost, np.float64) / np.maximum(chars, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n_words), pa.array(chars), pa.array(symbols), pa.array(dup, pa.int64()), pa.array(repeats), pa.array(base), pa.array(~base & (share <= rules.max_loss)), pa.array(lines, pa.int64())]
                    + [pa.array([f[k] for f in faults], pa.int64()) for k in FAULTS]
                    + [pa.array(share)]
                    + ([pa.array(cleaned, pa.string())] if with_text else []),
                    names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", *[f"lines_{f}" for f in FAULTS], "lost_percent", *(["cleaned"] if with_text else [])],
                )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, {schema}")
