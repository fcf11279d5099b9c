"""Phrase collocations, counted level by level through minimal perfect hashes.

Words of one language that occur ``least`` times get the slots of a minimal perfect hash; a text
becomes the stream of its words' slots, -1 where a word is rare or a piece ends. A phrase of
k + 1 words is the pair of the slots of its first and last k words, so it is a candidate only
where both are frequent (Apriori), and pairs name phrases exactly. For each length

* tasks gather the distinct pairs of their streams; the candidates get a minimal perfect hash,
  in shards of about ``SHARD`` keys that keep the keys themselves by slot. Pairs are counted in bins
  by hash before, and one in a bin below ``least`` is left out: a superset of the frequent pairs stays.
  There are more bins with more pairs, so that pairs which are not frequent do not fill them together,
  A few tasks tell of theirs first, the others only of pairs that those did not tell of,
* mappers look each pair up, compare it with the stored key, write the stream of slots and
  ``bincount`` them into arrays, a shard at a time,
* arrays of a shard are summed in a tree of groups of ``FAN``; slots below ``least`` are masked.

Cuts are read by slot: the parts of a phrase are phrases themselves, whose counts are handed up
level by level. Memory: a task holds ``CACHE`` bytes of shards and of arrays and a few million
stream elements; a larger table of shards is read again for each such block of elements.
Words are told apart by 128 bits of hash. Arithmetic is in whole numbers of up to 38 digits.

Edge cases: a null text is empty; a null lang is ``und``; repeated rows and rows that share a
doc_id, or have none, count each; texts without words add nothing; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptrail.llm import scratch
from peptrail.llm.textscan import MULTIPLIER, mix, powers

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
UNKNOWN = "und"
#: Keys of a shard of a hash, slots of an array that is summed, arrays that are summed at once.
SHARD, BLOCK, FAN = 1 << 18, 1 << 16, 8
#: Bytes of text, elements of streams, and elements of a stored row handled at once.
TEXT, ELEMENTS, ROW = 2 << 20, 1 << 19, 1024
CACHE = 48 << 20
#: Pairs are first counted in bins by hash, ``SPARE`` times as many as they could fill; in a bin below ``least`` no pair is a candidate.
SPARE = 12
#: Bins of a row of counts, as powers of two; bins whose bits a task holds; pairs that a task counts at once.
RANGE, BITS, PAIRS = 16, 28, 1 << 22
#: A task tells again of a pair only after so many others.
TOLD = 1 << 21
#: One in so many files of streams tells of its pairs before the others.
AHEAD = 16
U = np.uint64
WORD_ENDS, PIECE_ENDS = b" \t", b".,;:!?\n\v\f\r"
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(WORD_ENDS)], KIND[list(PIECE_ENDS)] = 1, 2
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
OTHER = mix(np.arange(1, 257, dtype=U) * U(MULTIPLIER))  # a second value for every byte


# -- texts to words ----------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Small-letter bytes, offsets and languages of runs of rows of about ``TEXT`` bytes."""
    texts, langs = batch.column("text"), batch.column("lang").to_pylist()
    _, where, raw = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(langs):
        to = min(len(langs), max(at + 1, int(np.searchsorted(offsets, offsets[at] + TEXT, "right")) - 1))
        yield SMALL[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at], langs[at:to]
        at = to


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of words, and whether a word is the first of its piece."""
    kind = KIND[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = inside[:-1] & ~edge[1:-1]
    after[:-1] = inside[1:] & ~edge[1:-1]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])[starts]  # piece ends before each word
    first = np.ones(len(starts), bool)
    first[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    return starts, ends, row, first


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word and its language."""
    salts = {x: np.frombuffer(hashlib.sha256(x.encode()).digest()[:16], dtype=U) for x in set(langs)}
    salt = np.array([salts[x] for x in langs], dtype=U).reshape(-1, 2)[row]
    out = (np.empty(len(starts), U), np.empty(len(starts), U))
    at = 0
    while at < len(starts):  # in stretches that stay in the processor's cache
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + (1 << 18), "right")))
        s, e = starts[at:to] - base, ends[at:to] - base
        piece = data[base : ends[to - 1]]
        up, down = powers(len(piece) + 1)
        for i, values in enumerate((piece.astype(U) + U(1), OTHER[piece])):
            sums = np.zeros(len(piece) + 1, dtype=U)
            np.cumsum(values * up[:-1], out=sums[1:])
            out[i][at:to] = mix((sums[e] - sums[s]) * down[s] ^ salt[at:to, i])
        at = to
    return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the first key, and where equal keys start in it; equal first keys with other differences may start twice."""
    order = np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, offsets, langs in _texts(batch):
            starts, ends, row, _ = _words(data, offsets)
            h1, h2 = _digests(data, starts, ends, row, langs)
            order, first = _runs(h1, h2)
            one = order[first]
            to = np.concatenate([[0], np.cumsum(ends[one] - starts[one])])
            letters = data[np.repeat(starts[one] - to[:-1], np.diff(to)) + np.arange(to[-1])]
            words = pa.StringArray.from_buffers(len(one), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(letters))
            names = pa.array(langs, pa.string()).take(pa.array(row[one]))
            n = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([names, words, *(pa.array(x.view(np.int64)) for x in (h1[one], h2[one])), pa.array(n)], ["lang", "word", "a", "b", "n"])


# -- minimal perfect hashes --------------------------------------------------------------------


def _place(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h ^ g * U(2 * level + 1)) % U(size)).astype(np.int64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.view(U) * U(MULTIPLIER) + mix(b.view(U)))


def _second(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(b.view(U) * U(MULTIPLIER) + mix(a.view(U) + U(1)))


class Hash:
    """A minimal perfect hash of distinct pairs ``(a, b)``: slots 0 to n - 1, and none (-1) for other pairs.

    A key's bit is set at its place in the first level where no other key that is left shares
    it; its slot is the number of bits before. ``a`` and ``b`` are kept in the order of slots.
    """

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.sizes, self.words, self.ranks, self.a, self.b = sizes, words, ranks, a, b

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Hash:
        h, g = pair_hash(a, b), _second(a, b)
        left, sizes, words, order = np.arange(len(a)), [], [], []
        while len(left):
            size = -(-max(64, len(left) + len(left) // 2) // 64) * 64
            at = _place(h[left], g[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            own = left[alone][np.argsort(at[alone])]
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            order.append(own)
            sizes.append(size)
            left = left[~alone]
        words = np.concatenate(words) if words else np.empty(0, U)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        return cls(sizes, words, ranks, a[order], b[order])

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int64)
        h, g, left, base = pair_hash(a, b), _second(a, b), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = _place(h[left], g[left], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(U)
            hit = (word >> bit & U(1)).astype(bool)
            out[left[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & ((U(1) << bit[hit]) - U(1)))
            left, base = left[~hit], base + size
            if not len(left):
                break
        found = np.flatnonzero(out >= 0)
        wrong = found[(self.a[out[found]] != a[found]) | (self.b[out[found]] != b[found])]  # stored keys decide
        out[wrong] = -1
        return out

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ranks.nbytes + self.a.nbytes + self.b.nbytes


HASHES = "shard int, n long, sizes array<int>, words binary, ranks binary, a binary, b binary"


def _narrow(keys: np.ndarray) -> np.ndarray:
    """Slots fit four bytes, the hashes of words do not."""
    return keys.astype(np.int32) if not len(keys) or np.abs(keys).max() < 1 << 31 and keys.min() >= 0 else keys


def _keys_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int32 if len(raw) == 4 * n else np.int64)


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    made = Hash.of(keys["a"].to_numpy(), keys["b"].to_numpy())
    return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "n": [len(keys)], "sizes": [made.sizes], "words": [made.words.tobytes()], "ranks": [made.ranks.tobytes()], "a": [_narrow(made.a).tobytes()], "b": [_narrow(made.b).tobytes()]})


class Shards:
    """The shards of a level's hash, and the masks of its frequent slots, as read in tasks; ``CACHE`` bytes are kept."""

    def __init__(self, hashes: str, masks: str | None, bases: list[int]):
        self.paths, self.bases = {"hash": hashes, "mask": masks}, np.array(bases, dtype=np.int64)
        self.held: OrderedDict[tuple[str, int], tuple] = OrderedDict()

    def _get(self, what: str, shard: int):
        if (what, shard) not in self.held:
            fs, folder = scratch.open_fs(self.paths[what])
            row = pq.read_table(folder, filesystem=fs, filters=[("shard", "=", shard)]).to_pylist()[0]
            if what == "mask":
                value = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little").astype(bool)
            else:
                read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
                value = Hash(row["sizes"], read("words", U), read("ranks", np.int64), *(_keys_of(row[x], row["n"]) for x in ("a", "b")))
            while self.held and sum(v.nbytes for v in self.held.values()) + value.nbytes > CACHE:
                self.held.popitem(last=False)
            self.held[what, shard] = value
        self.held.move_to_end((what, shard))
        return self.held[what, shard]

    @staticmethod
    def _by(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shards, kind="stable")
        starts = np.flatnonzero(np.diff(shards[order], prepend=-1))
        for i, j in zip(starts, np.append(starts[1:], len(order)), strict=True):
            yield int(shards[order[i]]), order[i:j]

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots over all shards of pairs ``(a, b)``; -1 for pairs that are none of the keys."""
        out = np.full(len(a), -1, dtype=np.int64)
        n = len(self.bases) - 1
        for shard, own in self._by(np.mod(pair_hash(a, b).view(np.int64), n)):
            if self.bases[shard + 1] > self.bases[shard]:
                local = self._get("hash", shard).slots(a[own], b[own])
                out[own] = np.where(local >= 0, local + self.bases[shard], -1)
        return out

    def masked(self, stream: np.ndarray) -> np.ndarray:
        """A stream with -1 for slots that are not frequent."""
        out = np.full(len(stream), -1, dtype=np.int64)
        at = np.flatnonzero(stream >= 0)
        for shard, own in self._by(np.searchsorted(self.bases, stream[at], "right") - 1):
            good = self._get("mask", shard)[stream[at[own]] - self.bases[shard]]
            out[at[own[good]]] = stream[at[own[good]]]
        return out


# -- streams -----------------------------------------------------------------------------------


def _squeezed(stream: np.ndarray) -> np.ndarray:
    """Runs of -1 as one, and single slots between them left out: they are in no pair."""
    good = stream >= 0
    beside = np.zeros(len(stream), bool)
    beside[1:] |= good[:-1]
    beside[:-1] |= good[1:]
    stream = np.where(good & beside, stream, -1)
    keep = stream >= 0
    keep[1:] |= stream[:-1] >= 0
    return stream[keep]


def _rows(stream: np.ndarray) -> Iterator[bytes]:
    """A stream cut behind -1s into rows of about ``ROW`` elements."""
    ends = np.flatnonzero(stream < 0) + 1
    at = 0
    while at < len(stream):
        i = np.searchsorted(ends, at + ROW)
        to = int(ends[i]) if i < len(ends) else len(stream)
        yield stream[at:to].tobytes()
        at = to


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Streams of rows joined by -1, about ``ELEMENTS`` at a time."""
    parts, n = [], 0
    for batch in batches:
        for row in batch.column("stream"):
            parts += [np.frombuffer(row.as_buffer(), dtype=np.int64), np.array([-1])]
            n += len(parts[-2]) + 1
            if n >= ELEMENTS:
                yield np.concatenate(parts)
                parts, n = [], 0
    if parts:
        yield np.concatenate(parts)


def _pairs(stream: np.ndarray) -> np.ndarray:
    """Where a slot is followed by another."""
    return np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0))


def _distinct(stream: np.ndarray, at: np.ndarray, told: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The distinct pairs at the places ``at`` of a stream whose hashes are not ``told``, and what is told then."""
    a, b = stream[at], stream[at + 1]
    h = pair_hash(a, b).view(np.int64)
    order, first = _runs(h, a, b)
    one = order[first]
    pairs = np.stack([h[one], a[one], b[one]])
    place = np.minimum(np.searchsorted(told[0], pairs[0]), max(len(told[0]) - 1, 0))
    known = (told[:, place] == pairs).all(axis=0) if told.size else np.zeros(len(one), bool)
    pairs = pairs[:, ~known]
    told = np.concatenate([told, pairs], axis=1) if told.shape[1] < TOLD else pairs
    told = told[:, np.argsort(told[0], kind="stable")]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["h", "a", "b"]), told


def _bits(pairs: int, least: int) -> int:
    """The bins for so many pairs are numbered by so many bits of a hash."""
    return max(RANGE, (SPARE * pairs // least).bit_length())


def _bins(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> U(64 - bits)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as they travel: most are zero where a task has few pairs."""
    raw = counts.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def _unpacked(counts: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts[4:], int.from_bytes(counts[:4], "little"), codec="lz4", asbytes=True), dtype=kind)


BINNED = pa.schema([("stream", pa.binary()), ("range", pa.int64()), ("bins", pa.binary()), ("counts", pa.binary())])


def _ranges(bins: np.ndarray, cap: int) -> pa.RecordBatch:
    """A row for each range with bins that are met: their places in it, and how often, up to ``cap``."""
    bins = np.sort(bins)
    first = np.flatnonzero(np.diff(bins, prepend=~bins[:1]))
    n = np.minimum(np.diff(np.append(first, len(bins))), cap).astype(np.uint8)
    met = bins[first]
    own, at = (met >> U(RANGE)).astype(np.int64), (met & U((1 << RANGE) - 1)).astype(np.uint16)
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    ends = np.append(starts[1:], len(own))
    parts = [[x[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)] for x in (at, n)]
    return pa.RecordBatch.from_arrays([pa.nulls(len(starts), pa.binary()), pa.array(own[starts]), *(pa.array(x, pa.binary()) for x in parts)], schema=BINNED)


def _binned(streams: Iterator[np.ndarray], cap: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The rows of streams, and counts of their pairs in bins, up to ``cap``, for each ``PAIRS`` pairs."""
    held, n = [], 0
    for stream in streams:
        stream = _squeezed(stream)
        at = _pairs(stream)
        held.append(_bins(pair_hash(stream[at], stream[at + 1]), bits))
        n += len(at)
        if n >= PAIRS:
            yield _ranges(np.concatenate(held), cap)
            held, n = [], 0
        rows = list(_rows(stream))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *(pa.nulls(len(rows), t) for t in BINNED.types[1:])], schema=BINNED)
    if n:
        yield _ranges(np.concatenate(held), cap)


def _first_streams(hashes: str, bases: list[int], cap: int, bits: int):
    """Streams of the slots of texts' words."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        words = Shards(hashes, None, bases)
        for batch in batches:
            for data, offsets, langs in _texts(batch):
                starts, ends, row, first = _words(data, offsets)
                slots = words.slots(*(x.view(np.int64) for x in _digests(data, starts, ends, row, langs)))
                stream = np.full(len(slots) + int(first.sum()), -1, dtype=np.int64)  # -1 before each piece
                stream[np.arange(len(slots)) + np.cumsum(first)] = slots
                yield stream

    return lambda batches: _binned(streams(batches), cap, bits)


def _next_streams(hashes: str, masks: str, bases: list[int], cap: int, bits: int):
    """Streams without the slots that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(hashes, masks, bases)
        return _binned((shards.masked(stream) for stream in _joined(batches)), cap, bits)

    return run


class Bins:
    """Whether a pair's bin is full. Full bins are few, as bins grow with the pairs; beyond 2 ** BITS bins a bit stands for several, and their numbers decide."""

    def __init__(self, path: str, bits: int):
        fs, folder = scratch.open_fs(path)
        rows = sorted(pq.read_table(folder, filesystem=fs).to_pylist(), key=lambda r: r["range"])
        parts = [np.frombuffer(r["bins"], np.uint16) for r in rows]
        bases = np.repeat(np.array([r["range"] for r in rows], dtype=U) << U(RANGE), [len(x) for x in parts])
        self.full, self.bits, self.shift = bases + np.concatenate([np.empty(0, np.uint16), *parts]), bits, U(max(0, bits - BITS))
        marks = self.full >> self.shift
        new = np.flatnonzero(np.diff(marks >> U(3), prepend=~U(0)))
        self.marks = np.zeros(1 << (min(bits, BITS) - 3), dtype=np.uint8)
        if len(new):
            self.marks[marks[new] >> U(3)] = np.bitwise_or.reduceat(np.uint8(1) << (marks & U(7)).astype(np.uint8), new)

    def pairs(self, stream: np.ndarray) -> np.ndarray:
        at = _pairs(stream)
        bins = _bins(pair_hash(stream[at], stream[at + 1]), self.bits)
        marks = bins >> self.shift
        good = (self.marks[marks >> U(3)] >> (marks & U(7)).astype(np.uint8) & 1).astype(bool)
        if self.shift:
            bins = bins[good]
            good[good] = self.full[np.minimum(np.searchsorted(self.full, bins), len(self.full) - 1)] == bins
        return at[good]


def _candidates(path: str, bits: int, known: list[tuple[str, list[int]]]):
    """Pairs of full bins that are in none of the hashes ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, told = Bins(path, bits), np.empty((3, 0), dtype=np.int64)
        before = [Shards(hashes, None, bases) for hashes, bases in known]
        for stream in _joined(batches):
            at = bins.pairs(stream)
            for shards in before:
                at = at[shards.slots(stream[at], stream[at + 1]) < 0]
            found, told = _distinct(stream, at, told)
            yield found

    return run


def _full(cap: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        at, n = (np.frombuffer(b"".join(group[x]), dtype=kind) for x, kind in (("bins", np.uint16), ("counts", np.uint8)))
        full = np.flatnonzero(np.bincount(at, weights=n) >= cap).astype(np.uint16)
        return pd.DataFrame({"range": group["range"].iloc[:1], "bins": [full.tobytes()]}).iloc[: len(full)]

    return run


COUNTED = pa.schema([("stream", pa.binary()), ("shard", pa.int32()), ("block", pa.int32()), ("task", pa.int64()), ("counts", pa.binary())])


def _counted(hashes: str, bases: list[int], full: str, bits: int):
    """Streams of the next level's slots, and each task's arrays of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, sums = Shards(hashes, None, bases), {}
        pairs = Bins(full, bits).pairs
        context = TaskContext.get()
        task = context.partitionId() if context else 0

        def flushed() -> pa.RecordBatch:
            out = [(None, s, i, task, _packed(part)) for s, n in sums.items() for i in range(-(-len(n) // BLOCK)) if (part := n[i * BLOCK : (i + 1) * BLOCK]).any()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(COUNTED.types)], schema=COUNTED)

        for stream in _joined(batches):
            at = pairs(stream)
            found = shards.slots(stream[at], stream[at + 1])
            after = np.full(len(stream), -1, dtype=np.int64)
            after[at] = found
            shard = np.searchsorted(shards.bases, found[found >= 0], "right") - 1
            for s, own in shards._by(shard):
                size = shards.bases[s + 1] - shards.bases[s]
                sums[s] = sums.get(s, 0) + np.bincount(found[found >= 0][own] - shards.bases[s], minlength=size)
                if sum(x.nbytes for x in sums.values()) > CACHE:
                    yield flushed()
            rows = list(_rows(_squeezed(after)))
            blank = lambda t: pa.nulls(len(rows), t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *(blank(t) for t in COUNTED.types[1:])], schema=COUNTED)
        yield flushed()

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(_unpacked(x, np.int64) for x in group["counts"])
    first = group.iloc[0]
    return pd.DataFrame({"shard": [first["shard"]], "block": [first["block"]], "task": [first["task"] // FAN], "counts": [_packed(total)]})


def _tree_sum(parts: DataFrame) -> DataFrame:
    """``(shard, block, task, counts)`` with one array a block: groups of ``FAN`` tasks, then of ``FAN`` groups, and so on."""
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("shard", "block", F.floor(F.col("task") / FAN)).applyInPandas(_summed, "shard int, block int, task long, counts binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return parts


def _frequent(least: int, bases: list[int]):
    def run(counts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        row = table.iloc[0]
        f = np.zeros(row["n"], dtype=np.int64)
        for block, part in zip(counts["block"], counts["counts"], strict=True):
            f[block * BLOCK : (block + 1) * BLOCK] += _unpacked(part, np.int64)
        good = f >= least
        at = np.flatnonzero(good)
        keys = [_keys_of(row[x], row["n"])[at].astype(np.int64) for x in ("a", "b")]
        return pd.DataFrame({"shard": [row["shard"]], "bits": [np.packbits(good, bitorder="little").tobytes()], "slot": [at + bases[row["shard"]]], "a": [keys[0]], "b": [keys[1]], "f": [f[at]]})

    return run


# -- levels ------------------------------------------------------------------------------------


def _folder(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


def _hashed(spark: SparkSession, keys: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """A minimal perfect hash of ``keys(h, a, b)``, a row a shard, and the first slot of every shard and one past the last."""
    keys = scratch.save(spark, keys, "keys")
    made = _hash(spark, keys)
    scratch.drop(spark, keys)
    return made


def _hash(spark: SparkSession, keys: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """``_hashed`` of saved keys, which stay."""
    n = keys.count()
    if not n:
        return None
    shards = -(-n // SHARD)
    dealt = keys.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "a", "b")
    table = scratch.save(spark, dealt.groupBy("shard").applyInPandas(_build, HASHES), "hash")
    sizes = {r.shard: r.n for r in table.select("shard", "n").collect()}  # one number a shard
    bases = [0]
    for shard in range(shards):
        bases.append(bases[-1] + sizes.get(shard, 0))
    return table, bases


def _keys(spark: SparkSession, binned: DataFrame, full: str, bits: int) -> tuple[DataFrame, list[int]] | None:
    """``_hashed`` of the distinct pairs of full bins in the streams of ``binned``.

    A pair that is frequent is in most tasks' streams. So one file in ``AHEAD`` (and one in its square before, and so on)
    is read first, and tasks over other files tell only of pairs that those did not tell of. Every file is read once.
    """
    files = sorted(binned.inputFiles())
    step = AHEAD
    while step * AHEAD <= len(files):
        step *= AHEAD
    left, told, known = set(files), [], []
    if not files:
        return None
    while left:
        some = [f for f in files[::step] if f in left]
        left.difference_update(some)
        streams = spark.read.schema(binned.schema).parquet(*some).where("stream is not null").select("stream")
        found = streams.mapInArrow(_candidates(full, bits, [(_folder(table), bases) for table, bases in known]), "h long, a long, b long").distinct()
        if left:
            told.append(scratch.save(spark, found, "told"))
            if made := _hash(spark, told[-1]):
                known.append(made)
            step //= AHEAD
    for before in told:
        found = found.union(before)  # of other pairs
    made = _hashed(spark, found)
    scratch.drop(spark, *told, *(table for table, _ in known))
    return made


def _bits_behind(level: DataFrame, least: int) -> int:
    """``_bits`` for the pairs of the next level: one at most begins where a phrase of this one occurs."""
    return _bits(level.agg(F.sum("f")).first()[0] or 0, least)


def phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language ``(lang, n)``, and for 1 to ``longest`` words (or fewer, if none are left) the frequent

    phrases ``(slot, a, b, f, lang, phrase, final, heads, tails)``: slots of the phrase and of its first and last
    words but one, its count, its last word, and the counts of its first and of its last 1, 2, … words.
    """
    rows = docs.select(docs["text"].alias("text"), F.coalesce(docs["lang"], F.lit(UNKNOWN)).alias("lang"))
    found = rows.mapInArrow(_count_words, "lang string, word string, a long, b long, n long")
    words = scratch.save(spark, found.groupBy("lang", "word").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.sum("n").alias("n")), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    h = lambda df: df.mapInArrow(_with_hash, "h long, a long, b long")
    made = _hashed(spark, h(frequent.select("a", "b")))
    if made is None:
        return sizes, []
    table, bases = made
    firsts = spark.createDataFrame(list(enumerate(bases[:-1])), "shard int, base long")
    slots = table.join(F.broadcast(firsts), "shard").mapInPandas(_keys_by_slot, "slot long, a long, b long")
    one = frequent.join(slots, ["a", "b"]).select("slot", "a", "b", F.col("n").alias("f"), "lang", F.col("word").alias("phrase"), F.col("word").alias("final"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    levels = [scratch.save(spark, one, "level1")]
    cap, binned_rows = min(least, 255), "stream binary, range long, bins binary, counts binary"
    bits = _bits_behind(levels[-1], least)
    binned = scratch.save(spark, rows.mapInArrow(_first_streams(_folder(table), bases, cap, bits), binned_rows), "streams1")
    for k in range(2, longest + 1):
        full = scratch.save(spark, binned.where("stream is null").drop("stream").groupBy("range").applyInPandas(_full(cap), "range long, bins binary"), "full")
        streams = binned.where("stream is not null").select("stream")
        made = _keys(spark, binned, _folder(full), bits)
        if made is None:
            break
        table, bases = made
        counted = scratch.save(spark, streams.mapInArrow(_counted(_folder(table), bases, _folder(full), bits), "stream binary, shard int, block int, task long, counts binary"), f"counted{k}")
        scratch.drop(spark, binned, full)
        sums = _tree_sum(counted.where("stream is null").drop("stream"))
        kept = sums.groupBy("shard").cogroup(table.groupBy("shard")).applyInPandas(_frequent(least, bases), "shard int, bits binary, slot array<bigint>, a array<bigint>, b array<bigint>, f array<bigint>")
        kept = scratch.save(spark, kept, f"frequent{k}")
        found = kept.select(F.explode(F.arrays_zip("slot", "a", "b", "f")).alias("x")).select("x.*")
        below = levels[-1]
        left = below.select(F.col("slot").alias("a"), "lang", F.col("phrase").alias("start"), F.col("heads").alias("before"))
        right = below.select(F.col("slot").alias("b"), "final", F.col("tails").alias("behind"))
        both = found.join(left, "a").join(right, "b")
        level = both.select("slot", "a", "b", "f", "lang", F.concat_ws(" ", "start", "final").alias("phrase"), "final", F.concat("before", F.array("f")).alias("heads"), F.concat("behind", F.array("f")).alias("tails"))
        levels.append(scratch.save(spark, level, f"level{k}"))
        if k < longest:
            bits = _bits_behind(levels[-1], least)
            next_ = counted.where("stream is not null").select("stream").mapInArrow(_next_streams(_folder(table), _folder(kept), bases, cap, bits), binned_rows)
            binned = scratch.save(spark, next_, f"streams{k}")
        scratch.drop(spark, counted)
    return sizes, levels


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(x).to_numpy() for x in ("a", "b"))
        yield pa.RecordBatch.from_arrays([pa.array(pair_hash(a, b).view(np.int64)), pa.array(a), pa.array(b)], ["h", "a", "b"])


def _keys_by_slot(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for r in part.itertuples():
            yield pd.DataFrame({"slot": np.arange(r.n) + r.base, "a": _keys_of(r.a, r.n).astype(np.int64), "b": _keys_of(r.b, r.n).astype(np.int64)})


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The best ``top`` collocations of each lang: lang, rank, phrase, a, l, r, n, score; see the module.

    A candidate is left out where a longer one that holds its words has ``share`` percent of its
    count. Such a one need only be looked for among those one word longer: what lies between
    the two is a candidate and at least as frequent.
    """
    sizes, levels = phrases(spark, docs, least, longest)
    wide = lambda c: F.col(c).cast("decimal(30,0)")
    out = None
    for k in range(2, len(levels) + 1):
        level = levels[k - 1].join(F.broadcast(sizes), "lang")  # one row a language
        if k < len(levels):
            longer = levels[k].select(F.explode(F.array("a", "b")).alias("slot"), "f").groupBy("slot").agg(F.max("f").alias("most"))
            level = level.join(longer, "slot", "left").where(F.coalesce(100 * wide("most") < share * wide("f"), F.lit(True)))
        cuts = []
        for cut in range(1, k):
            first, rest = F.col("heads")[cut - 1], F.col("tails")[k - cut - 1]
            cuts.append(F.struct(_score(F.col("f"), F.col("n"), first, rest).alias("score"), F.lit(cut).alias("k"), first.alias("l"), rest.alias("r")))
        best = F.array_min(F.array(*cuts))
        rows = level.select("lang", "phrase", F.col("f").alias("a"), "n", best.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (left * right))`` in whole numbers."""
    over = F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(17,0)") * n.cast("decimal(17,0)")
    under = left.cast("decimal(19,0)") * right.cast("decimal(19,0)")
    return F.call_function("div", over, under)
