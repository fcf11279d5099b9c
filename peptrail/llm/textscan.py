"""Whole-batch word splitting and rolling hashes on Arrow string buffers.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; these are all
one-byte characters in UTF-8, so bytes can be scanned without decoding. A word's hash is a
polynomial over its bytes modulo 2^64, followed by a mixing step; a window's hash is a
polynomial over the mixed hashes of its words. Work proceeds in blocks of rows of about
``BLOCK`` bytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Block:
    """Some consecutive rows of a batch and their words.

    ``first[i]:first[i+1]`` are the words of row ``row0 + i``; ``starts``/``ends`` are byte
    positions in ``data``.
    """

    row0: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    @property
    def left(self) -> np.ndarray:
        """Words from each word to the end of its row, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=U)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + BLOCK, "right")))
            piece = self.data[base : self.ends[to - 1]].astype(U) + U(1)
            up, down = powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=U)
            np.cumsum(piece * up[:-1], out=sums[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = mix((sums[e] - sums[s]) * down[s])
            at = to
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Rolling:
    """Hashes of runs of words from any start and of any length."""

    def __init__(self, hashes: np.ndarray, seed: int = 0):
        up, self.down = powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=U)
        np.cumsum(mix(hashes ^ U(seed)) * up[:-1], out=self.sums[1:])

    def at(self, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + n] - self.sums[starts]) * self.down[starts] + n.astype(U))


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each word on; callers mask starts with fewer words left."""
    if len(hashes) < n:
        return np.empty(0, dtype=U)
    whole = Rolling(hashes, seed)
    return mix((whole.sums[n:] - whole.sums[:-n]) * whole.down[: len(hashes) - n + 1] + U(n))


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Blocks of rows of at most ``limit`` bytes (a longer text is a block of its own)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    _, where, raw = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield split(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def split(row0: int, data: np.ndarray, offsets: np.ndarray) -> Block:
    inside = ~SPACES[data]
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets] = True
    before = np.empty(len(data), dtype=bool)  # whether a word can go on from the byte before
    if len(data):
        before[0] = False
        before[1:] = inside[:-1] & ~breaks[1:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    if len(data):
        after[:-1] = inside[1:] & ~breaks[1:-1]
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Block(row0, len(offsets) - 1, data, offsets, starts, ends, first)


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array with ``counts[i]`` of the values in row i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())
