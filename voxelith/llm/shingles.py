"""Word shingles of whole texts, hashed with array operations instead of word by word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from voxelith.llm.common import mix64

SEGMENT = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_TURN = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SEGMENT + 4096)
            inverse = pow(_BASE, -1, 2**64)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _BASE, dtype=np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, inverse, dtype=np.uint64))])
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Shingled:
    """Shingle hashes of many texts: those of text i are values[bounds[i]:bounds[i + 1]], in
    text order and with repeats; words[i] is its number of words."""

    values: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    sequence: np.ndarray


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` and the first word of each text.

    A word's hash is a polynomial over its bytes; a running sum over a segment gives all of
    a segment's words at once. Null texts have no words.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    ends_at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[ends_at[0] : ends_at[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends_at = ends_at - ends_at[0]
    ink = np.zeros(len(data) + 2, dtype=bool)
    ink[1:-1] = ~_SPACE[data]
    opens = ink[1:-1] & ~ink[:-2]
    shuts = ink[1:-1] & ~ink[2:]
    edge = ends_at[(ends_at > 0) & (ends_at < len(data))]
    opens[edge] |= ink[1:-1][edge]
    shuts[edge - 1] |= ink[1:-1][edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        stop = max(at + 1, int(np.searchsorted(start, base + SEGMENT)))
        size = int(end[stop - 1] - base)
        up, down = _POWERS.get(size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = start[at:stop] - base, end[at:stop] - base
        out[at:stop] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out, np.searchsorted(start, ends_at)


def shingled(texts: pa.Array, size: int = 5) -> Shingled:
    """Shingles of size words; a text of fewer words is one shingle, without words none."""
    words, first = word_hashes(texts)
    count = np.diff(first)
    n = len(words)
    place = np.arange(n) - np.repeat(first[:-1], count)
    order = mix64(words + mix64(place.astype(np.uint64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(order)])
    twist = np.concatenate([[np.uint64(0)], np.cumsum(mix64(order + np.uint64(1)))])
    sequence = np.stack([sums[first[1:]] - sums[first[:-1]], twist[first[1:]] - twist[first[:-1]]], axis=1)
    if n >= size:
        total = words[: n - size + 1] * _TURN[0]
        for k in range(1, size):
            total = total + words[k : n - size + 1 + k] * _TURN[k]
        total = mix64(total)
    else:
        total = np.zeros(0, dtype=np.uint64)
    starts = np.maximum(count - size + 1, 0)
    keep = np.zeros(n + 1, dtype=np.int64)
    np.add.at(keep, first[:-1][starts > 0], 1)
    np.add.at(keep, (first[:-1] + starts)[starts > 0], -1)
    values = total[np.flatnonzero(np.cumsum(keep)[:-1][: len(total)] > 0)] if len(total) else total
    short = np.flatnonzero((count > 0) & (count < size))
    sizes = starts.copy()
    sizes[short] = 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if len(short):
        merged = np.empty(bounds[-1], dtype=np.uint64)
        fill = np.ones(bounds[-1], dtype=bool)
        fill[bounds[short]] = False
        merged[fill] = values
        for i in short:
            own = words[first[i] : first[i + 1]]
            merged[bounds[i]] = mix64(np.array([(own * _TURN[: len(own)]).sum() + np.uint64(len(own))], dtype=np.uint64))[0]
        values = merged
    return Shingled(values, bounds, count, sequence)


def minhash(found: Shingled, coordinates: int) -> np.ndarray:
    """One byte of each minimum: a (texts, coordinates) matrix; texts without shingles get 0."""
    n = len(found.bounds) - 1
    out = np.zeros((n, coordinates), dtype=np.uint8)
    some = np.flatnonzero(np.diff(found.bounds))
    if not len(some):
        return out
    starts = found.bounds[some]
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 2**64, coordinates, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**64, coordinates, dtype=np.uint64)
    for begin in range(0, len(some), 512):
        rows = some[begin : begin + 512]
        base = found.bounds[rows[0]]
        values = found.values[base : found.bounds[rows[-1] + 1]]
        at = starts[begin : begin + 512] - base
        for k in range(coordinates):
            least = np.minimum.reduceat(values * odd[k] + add[k], at)
            out[rows, k] = (mix64(least) >> np.uint64(56)).astype(np.uint8)
    return out
