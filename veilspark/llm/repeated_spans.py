"""Operator 6: removal of long repeats by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else, in any document. Strings do not cross
documents and are judged on the input.

Which suffixes are sorted: every window of `length` bytes belongs to the position of its least k-byte hash (a
function of its content, so equal windows belong to equal positions); the windows of one position form runs. A run's
string goes from its first window's start to its last window's end. Fingerprints over the whole corpus (duplicate
detection ahead of a string sort) tell runs apart: a run whose string has no second fingerprint and whose core (216
bytes that all of its windows share) occurs in no other run has no repeat. Runs with a second fingerprint are sorted:
each task sorts its strings, merges equal ones, cuts the sorted run at range splitters and front-codes it (length of
the prefix shared with the string before, and the rest); a range's runs are merged by a loser tree that carries these
lengths, compares them first, and characters only beyond what is known to be shared. Neighbours' common prefixes of
`length` or more are repeats. Runs with a repeated core only, at the edges of repeats, have all of their windows
compared by 128-bit fingerprints, against the windows of one run of every string with that core.

Copies: texts that are equal as a whole are one text in all of this; if `length` bytes or longer they go entirely.
No group of copies meets in one task: a task sends one of equal strings or windows.

Defined results: a null text counts as empty; texts shorter than `length` stay; a null or repeated id is an ordinary
row; an empty table gives an empty result. Other columns are not read. A very long text is looked at in slices of 4 MB
and hashed in memory of a bounded size; the text itself has to fit in a task.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.blooms import bloom_of, may_hold
from veilspark.llm.runtime import batches, join_salted, released, written
from veilspark.llm.textbytes import BASE, Chunk, mix, powers

_rng = np.random.default_rng(20240301)
TABLES = tuple(_rng.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2))
BASES = (BASE, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


@dataclass(frozen=True)
class RepeatRule:
    """length: bytes of a repeat. gram: bytes of the hash that places windows. part_bytes: of strings and windows
    that one task of the merge takes. flush_bytes: of strings that a task sorts at once. sample_every: one of so many
    strings, by its fingerprint, is a sample for the cuts between ranges."""

    length: int = 400
    gram: int = 32
    part_bytes: int = 24 << 20
    flush_bytes: int = 32 << 20
    sample_every: int = 256

    @property
    def reach(self) -> int:
        return self.length - self.gram + 1

    @property
    def left(self) -> int:
        """A window that starts up to so many bytes before its position holds the core right of it."""
        return (self.length - self.gram) // 2


class Hashed:
    """Fingerprints of spans of a byte array by one of two polynomials."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLES[which][data] * powers(BASES[which], len(data)), out=self.prefix[1:])
        self.back = powers(INVERSES[which], len(data) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


#: Bytes of a text whose windows are looked at together; about a hundred times as many bytes of memory are held.
SLICE = 4 << 20


def window_runs(data: np.ndarray, offsets: np.ndarray, rule: RepeatRule, step: int = SLICE) -> tuple[np.ndarray, ...]:
    """Runs of windows of one position and side: text, start of the first window, number of windows less one,
    fingerprint of the whole string, and of the core. Starts count from the text's own start. A longer text is taken
    in slices; a run that a slice cuts is two runs, whose windows are compared like those of any other."""
    if len(offsets) != 2 or len(data) <= step:
        return _runs_of(data, offsets, rule)
    parts = []
    for lo in range(0, len(data) - rule.length + 1, step):
        part = data[lo : lo + step + rule.length - 1]
        text, start, *rest = _runs_of(part, np.array([0, len(part)]), rule)
        parts.append((text, start + lo, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs_of(data: np.ndarray, offsets: np.ndarray, rule: RepeatRule) -> tuple[np.ndarray, ...]:
    n, length = len(data), rule.length
    sizes = np.diff(offsets)
    valid = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, (offsets[1:] - length + 1)[long], -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0) if n else np.zeros(0, np.int64)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashed = Hashed(data)
    grams = np.arange(n - rule.gram + 1)
    bits = np.uint64(max(28, int(n).bit_length()))  # the same for all but huge texts: ties have to be broken alike
    least = (hashed.spans(grams, grams + rule.gram) >> bits << bits) | grams.astype(np.uint64)
    reach, step = rule.reach, 1
    while 2 * step <= reach:
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least
        step *= 2
    if reach > step:
        least = np.minimum(least[: len(least) - (reach - step)], least[reach - step :])
    place = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    right = place - at <= rule.left
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (right[1:] != right[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    start, end, place, right = at[first], at[last], place[first], right[first]
    core = np.where(right, place, place - rule.left)
    core_end = np.where(right, place + length - rule.left, place + rule.gram)
    text = np.searchsorted(offsets, start, "right") - 1
    whole = hashed.spans(start, end + length)
    cores = hashed.spans(core, core_end) ^ np.where(right, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    return text, start - offsets[text], end - start, whole.view(np.int64), cores.view(np.int64)


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no comparison."""
    n = min(len(a), len(b))
    step = 64
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            m = min(len(x), len(y))
            x, y = x[:m], y[:m]
            if x == y:
                return known + m
            z = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return known + m - (z.bit_length() + 7) // 8
        known += len(x)
        step *= 4
    return n


Item = tuple[bytes, int, list[tuple[bytes, int]]]  # a string, the prefix shared with the one before, where it stands


def front_code(items: list[tuple[bytes, list[tuple[bytes, int]]]]) -> bytes:
    """Sorted distinct strings with their places (name of the text, start)."""
    names: dict[bytes, int] = {}
    common, rests, counts, places = [], [], [], []
    before = b""
    for string, where in items:
        k = shared(before, string)
        common.append(k)
        rests.append(string[k:])
        counts.append(len(where))
        for name, start in where:
            places.append((names.setdefault(name, len(names)), start))
        before = string
    arrays = [np.array(common, np.uint32), np.array([len(r) for r in rests], np.uint32), np.array(counts, np.uint32), np.array(places, np.uint32).reshape(-1)]
    return struct.pack("<3I", len(items), len(places), len(names)) + b"".join(a.tobytes() for a in arrays) + b"".join(names) + b"".join(rests)


def decode(raw: bytes) -> Iterator[Item]:
    n, n_places, n_names = struct.unpack_from("<3I", raw)
    at = 12
    common, sizes, counts = (np.frombuffer(raw, np.uint32, n, at + 4 * n * j).tolist() for j in range(3))
    at += 12 * n
    places = np.frombuffer(raw, np.uint32, 2 * n_places, at).reshape(-1, 2).tolist()
    at += 8 * n_places
    names = [raw[at + 16 * j : at + 16 * j + 16] for j in range(n_names)]
    at += 16 * n_names
    string, p = b"", 0
    for k, size, count in zip(common, sizes, counts, strict=True):
        string = string[:k] + raw[at : at + size]
        at += size
        yield string, k, [(names[x], y) for x, y in places[p : p + count]]
        p += count


class LoserTree:
    """Merges sorted runs. Every waiting string carries the prefix that it shares with the last one put out, so that
    the longer prefix wins unseen and equal ones are compared from there on."""

    def __init__(self, runs: list[Iterator[Item]]):
        self.runs = runs
        self.k = 1
        while self.k < max(1, len(runs)):
            self.k *= 2
        self.heads: list[Item | None] = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.known = [0] * self.k
        self.losers = [0] * self.k
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The loser stays in the node, with the prefix that it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            a, b = (b, a) if x is None else (a, b)
        elif self.known[a] != self.known[b]:
            if self.known[a] < self.known[b]:
                a, b = b, a
        else:
            k = shared(x[0], y[0], self.known[a])
            if k < len(y[0]) and (k == len(x[0]) or x[0][k] < y[0][k]) or k == len(x[0]) == len(y[0]):
                self.known[b] = k
            else:
                self.known[a] = k
                a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[Item]:
        while (head := self.heads[self.winner]) is not None:
            w = self.winner
            yield head[0], self.known[w], head[2]
            following = next(self.runs[w], None)
            self.heads[w] = following
            self.known[w] = following[1] if following else 0
            node = (w + self.k) // 2
            while node:
                w = self._play(node, self.losers[node], w)
                node //= 2
            self.winner = w


def merged_repeats(runs: list[Iterator[Item]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """(text, start, end) of the prefixes of sorted strings that a neighbour shares, if long enough."""
    held: list[tuple[bytes, int]] = []
    size = common = 0

    def put(following: int) -> Iterator[tuple[bytes, int, int]]:
        long = size if len(held) > 1 else max(common, following)
        if long >= length:
            for name, start in held:
                yield name, start, start + long

    before = None
    for string, k, places in LoserTree(runs):
        if before is not None and k == len(before) == len(string):
            held = held + places
            continue
        yield from put(k)
        held, size, common, before = list(places), len(string), k, string
    yield from put(0)


def _described(docs: DataFrame, rule: RepeatRule) -> DataFrame:
    kind = dict(docs.dtypes)["id"]
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("more", pa.int32()), ("whole", pa.int64()), ("core", pa.int64())]))
    sample_type = pa.list_(pa.struct([("whole", pa.int64()), ("start", pa.binary())]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in frames:
            for lo, hi in batches(batch, "text"):
                part = batch.slice(lo, hi - lo)
                chunk = Chunk(part.column("text"))
                names = part.column("name").to_pylist()
                text, start, more, whole, core = window_runs(chunk.data, chunk.offsets, rule)
                at = start + chunk.offsets[text] if len(text) else start
                drawn = np.flatnonzero((whole.view(np.uint64) >> np.uint64(20)) % np.uint64(rule.sample_every) == 0)  # for the splitters
                samples: list[list[dict]] = [[] for _ in range(chunk.n)]
                for i in drawn.tolist():
                    samples[text[i]].append({"whole": int(whole[i]), "start": chunk.data[at[i] : at[i] + rule.length].tobytes()})
                counts = np.bincount(text, minlength=chunk.n) if len(text) else np.zeros(chunk.n, np.int64)
                fresh = np.array([not (x in seen or seen.add(x)) for x in names], bool)
                kept = fresh[text] if len(text) else np.zeros(0, bool)
                offsets = np.concatenate([[0], np.cumsum(np.where(fresh, counts, 0))])
                fields = [pa.array(start[kept].astype(np.int32)), pa.array(more[kept].astype(np.int32)), pa.array(whole[kept]), pa.array(core[kept])]
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(run_type.value_type)))
                digests = [hashlib.sha256(chunk.text(i)).hexdigest() for i in range(chunk.n)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("name"), pa.array(np.diff(chunk.offsets)), pa.array(digests), runs, pa.array(samples, sample_type)], names=["id", "name", "n_bytes", "sha256", "runs", "samples"])

    return docs.mapInArrow(released(run), f"id {kind}, name binary, n_bytes long, sha256 string, runs array<struct<start:int,more:int,whole:long,core:long>>, samples array<struct<whole:long,start:binary>>")


def _needed_texts(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, text) of the texts named, and perhaps of some others; a task gives equal texts once."""
    held = bloom_of(names, "name")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = may_hold(held.value)
        seen: set[bytes] = set()
        for batch in frames:
            own = batch.column("name").to_pylist()
            keep = [i for i, x in enumerate(own) if x not in seen and hit(x) and not seen.add(x)]
            for lo, hi in batches(taken := batch.take(pa.array(keep, pa.int64())), "text"):
                yield taken.slice(lo, hi - lo)

    return docs.select("name", "text").mapInArrow(released(run), "name binary, text string").groupBy("name").agg(F.first("text").alias("text"))


def splitters(samples: DataFrame, parts: int) -> list[bytes]:
    """parts - 1 strings at most, in order, between which about as many of the sampled strings (one column) stand.

    Samples are sorted by Spark; the driver gets the cuts alone, no longer than they need be to tell neighbours apart.
    Samples are starts of `length` bytes, so that strings that share as much are in one range.
    """
    n = samples.count()
    every = max(1, n // parts)
    tasks = max(1, n // 50_000)

    def pick(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting = None, 0
        for batch in frames:
            cuts = []
            for x in batch.column(0).to_pylist():
                waiting += 1
                if waiting >= every and before is not None and x != before:
                    cuts.append(x[: shared(before, x) + 1])
                    waiting = 0
                before = x
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.binary())], names=["cut"])

    (column,) = samples.columns
    ordered = samples.repartitionByRange(tasks, column).sortWithinPartitions(column)
    return sorted({r.cut for r in ordered.mapInArrow(pick, "cut binary").collect()})


def _stretches(ranges: list[np.ndarray], step: int = SLICE) -> Iterator[np.ndarray]:
    """Starts of windows in order, those of a stretch of the text together."""
    if ranges:
        at = np.sort(np.concatenate(ranges))
        for stretch in np.split(at, np.flatnonzero(np.diff(at // step)) + 1):
            yield stretch


def _sent(texts: DataFrame, cuts: list[bytes], parts: int, rule: RepeatRule) -> DataFrame:
    """texts: name, text, marks. Rows (part, kind, payload): front-coded runs of strings (0), blocks of windows (1),
    and repeats found inside the task (2, as triples)."""
    length = rule.length

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: dict[bytes, list[tuple[bytes, int]]] = {}
        held = 0
        windows: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []
        n_windows = 0
        out: list[tuple[int, int, bytes]] = []

        def flush_strings() -> None:
            ordered = sorted(strings.items())
            lo = 0
            while lo < len(ordered):
                part = bisect_right(cuts, ordered[lo][0])
                hi = bisect_left(ordered, cuts[part], lo, key=itemgetter(0)) if part < len(cuts) else len(ordered)
                out.append((part, 0, front_code(ordered[lo:hi])))
                lo = hi
            strings.clear()

        def flush_windows() -> None:
            if not windows:
                return
            one, two, start = (np.concatenate([w[j] for w in windows]) for j in range(3))
            text = np.repeat(np.arange(len(windows)), [len(w[0]) for w in windows])
            names = b"".join(w[3] for w in windows)
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            twice = np.zeros(len(order), bool)
            twice[1:] |= same
            twice[:-1] |= same
            found = order[twice]
            if len(found):
                triples = [struct.pack("<16s2q", names[16 * t : 16 * t + 16], lo, hi) for t, lo, hi in joined_windows(text[found], start[found], length)]
                for i in range(0, len(triples), 4096):
                    out.append((int(one[found[0]] + np.uint64(i)) % parts, 2, b"".join(triples[i : i + 4096])))
            lead = order[np.concatenate([[True], ~same])]  # one of equal windows
            part = (one[lead] % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part):
                own = lead[part == p]
                refs, local = np.unique(text[own], return_inverse=True)
                body = struct.pack("<2I", len(own), len(refs)) + one[own].tobytes() + two[own].tobytes() + start[own].astype(np.int64).tobytes() + local.astype(np.int32).tobytes() + b"".join(names[16 * r : 16 * r + 16] for r in refs)
                out.append((int(p), 1, body))
            windows.clear()

        def drain() -> Iterator[pa.RecordBatch]:
            size = 0
            while out:
                lot = []
                while out and size < 16 << 20 and len(lot) < 10_000:
                    lot.append(out.pop())
                    size += len(lot[-1][2])
                size = 0
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in lot], pa.int32()), pa.array([x[1] for x in lot], pa.int32()), pa.array([x[2] for x in lot], pa.binary())], names=["part", "kind", "payload"])

        for batch in frames:
            for name, text, marks in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "marks")), strict=True):
                raw = text.encode()
                ranges = []
                for m in marks:
                    if m["sort"]:
                        string = raw[m["start"] : m["start"] + m["more"] + length]
                        where = strings.get(string)
                        if where is None:
                            strings[string] = [(name, m["start"])]
                            held += len(string) + 200
                        else:
                            where.append((name, m["start"]))
                            held += 80
                    if m["windows"]:
                        ranges.append(np.arange(m["start"], m["start"] + m["more"] + 1))
                for at in _stretches(ranges):
                    low = int(at[0])
                    data = np.frombuffer(raw, np.uint8)[low : int(at[-1]) + length]
                    both = [Hashed(data, j).spans(at - low, at - low + length) for j in range(2)]
                    windows.append((both[0], both[1], at, name))
                    n_windows += len(at)
                    if n_windows > 1 << 20:
                        flush_windows()
                        n_windows = 0
                if held > rule.flush_bytes:
                    flush_strings()
                    held = 0
                if len(out) > 1000:
                    yield from drain()
        flush_strings()
        flush_windows()
        yield from drain()

    return texts.select("name", "text", "marks").mapInArrow(released(run), "part int, kind int, payload binary")


def joined_windows(text: np.ndarray, start: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """Windows as intervals (text, start, end), consecutive ones joined."""
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(text)]]) - 1
    yield from zip(text[first].tolist(), start[first].tolist(), (start[last] + length).tolist(), strict=True)


def _received(sent: DataFrame, parts: int, rule: RepeatRule) -> DataFrame:
    """Repeats (name, start, end) from the merges of all parts."""
    length = rule.length

    def solve(kinds: dict[int, list[bytes]]) -> Iterator[tuple[bytes, int, int]]:
        for raw in kinds.get(2, ()):
            yield from struct.iter_unpack("<16s2q", raw)
        if 0 in kinds:
            yield from merged_repeats([decode(raw) for raw in kinds[0]], length)
        if 1 in kinds:
            ones, twos, starts, texts, names = [], [], [], [], []
            for raw in kinds[1]:
                n, n_names = struct.unpack_from("<2I", raw)
                ones.append(np.frombuffer(raw, np.uint64, n, 8))
                twos.append(np.frombuffer(raw, np.uint64, n, 8 + 8 * n))
                starts.append(np.frombuffer(raw, np.int64, n, 8 + 16 * n))
                texts.append(np.frombuffer(raw, np.int32, n, 8 + 24 * n).astype(np.int64) + len(names))
                at = 8 + 28 * n
                names += [raw[at + 16 * j : at + 16 * j + 16] for j in range(n_names)]
            one, two, start, text = map(np.concatenate, (ones, twos, starts, texts))
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            twice = np.zeros(len(order), bool)
            twice[1:] |= same
            twice[:-1] |= same
            found = order[twice]
            if len(found):
                for t, lo, hi in joined_windows(text[found], start[found], length):
                    yield names[t], lo, hi

    def packed(found: Iterator[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple[bytes, int, int]] = []
        for x in found:
            lot.append(x)
            if len(lot) == 50_000:
                yield batch_of(lot)
                lot = []
        if lot:
            yield batch_of(lot)

    def batch_of(lot: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in lot], pa.binary()), pa.array([x[1] for x in lot], pa.int64()), pa.array([x[2] for x in lot], pa.int64())], names=["name", "start", "end"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds = None, {}
        for batch in frames:
            for part, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "payload")), strict=True):
                if part != now:
                    yield from packed(solve(kinds))
                    now, kinds = part, {}
                kinds.setdefault(kind, []).append(payload)
        yield from packed(solve(kinds))

    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(released(run), "name binary, start long, end long")


def _cut(texts: DataFrame) -> DataFrame:
    """texts: name, text, found (intervals). The bytes removed, spans, and digest of what stays."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            rows = []
            for name, text, found in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "found")), strict=True):
                raw = text.encode()
                spans: list[list[int]] = []
                for s, e in sorted((f["start"], f["end"]) for f in found):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                rows.append((name, sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string(), span))], names=["name", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.select("name", "text", "found").mapInArrow(released(run), "name binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: RepeatRule = RepeatRule()) -> DataFrame:
    """One row for each document: id_col, n_bytes, n_removed, n_spans, kept_sha256, has_repeat and spans (bytes, ends exclusive)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    docs = docs.select(docs[id_col].alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("name"))
    rows = written(_described(docs, rule), "described")
    copies = rows.groupBy("name").agg(F.count("*").alias("copies"))
    total = rows.count()
    runs = rows.select("name", F.explode("runs").alias("r")).select("name", "r.*")
    place = F.struct("name", "start")
    wholes = written(runs.groupBy("whole", "core").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("rows")).select("whole", "core", "low", "rows", (F.col("low") != F.col("high")).alias("twice")), "wholes")
    n_runs = wholes.agg(F.sum("rows")).first()[0] or 0
    if not n_runs:
        return rows.select(F.col("id").alias(id_col), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"), F.lit(False).alias("has_repeat"))
    n_wholes = wholes.count()
    mixed = wholes.groupBy("core").agg(F.count("*").alias("n_wholes"), F.sum(F.when(F.col("twice"), 0).otherwise(1)).alias("singles")).where("n_wholes > 1 AND singles > 0").select("core", "n_wholes")
    known = join_salted(wholes, mixed, "core", "n_wholes", n_wholes, F.xxhash64("whole"), "left").where("twice OR n_wholes IS NOT NULL").select("whole", "rows", "low", "twice", F.col("n_wholes").isNotNull().alias("mixed"))
    known = written(known, "known")
    marked = join_salted(runs.drop("core"), known, "whole", "rows", n_runs, F.xxhash64("name", "start"))
    marked = marked.select("name", "start", "more", F.col("twice").alias("sort"), (F.col("mixed") & (~F.col("twice") | (F.struct("name", "start") == F.col("low")))).alias("windows"))
    marks = written(marked.where("sort OR windows").groupBy("name", "start").agg(F.first("more").alias("more"), F.max("sort").alias("sort"), F.max("windows").alias("windows")), "marks")
    weight = marks.agg(F.sum(F.when(F.col("sort"), F.col("more") + rule.length).otherwise(0) + F.when(F.col("windows"), 30 * (F.col("more") + 1)).otherwise(0))).first()[0] or 0
    parts = max(8, -(-weight // rule.part_bytes))
    drawn = rows.select(F.inline("samples")).groupBy("whole").agg(F.first("start").alias("start"))
    cuts = splitters(written(drawn.join(known.where("twice"), "whole", "left_semi").select("start"), "samples"), parts)
    by_text = marks.groupBy("name").agg(F.collect_list(F.struct("start", "more", "sort", "windows")).alias("marks"))
    names = marks.select("name").distinct()
    texts = written(_needed_texts(docs, names).join(by_text, "name"), "texts")
    found = _received(_sent(texts, cuts, parts, rule), parts, rule)
    by_name = written(found.groupBy("name").agg(F.collect_list(F.struct("start", "end")).alias("found")), "found")
    cut = written(_cut(texts.join(by_name, "name")), "cut")
    counts = join_salted(rows.drop("runs", "samples"), copies, "name", "copies", total, F.xxhash64("id"))
    out = counts.join(cut.withColumn("copies", F.lit(1).cast("long")), ["name", "copies"], "left")  # a text with copies goes whole and needs no lookup
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= rule.length)
    found = out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)"))).alias("spans"),
    )
    return found.withColumn("has_repeat", F.col("n_removed") > 0)
