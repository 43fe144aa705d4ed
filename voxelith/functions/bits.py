"""Packed arrays of longs, as column expressions and as array code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def unpack_aligned(name: str, bits: int, count: int) -> Column:
    """count values of bits each; a long holds 64 // bits values and none spans two longs."""
    each, mask = 64 // bits, (1 << bits) - 1
    return F.expr(
        f"transform(sequence(0, {count - 1}), i -> cast(shiftrightunsigned(coalesce(get({name}, cast(i div {each} as int)), 0L), "
        f"cast((i % {each}) * {bits} as int)) & {mask} as int))"
    )


def unpack_stream(name: str, bits: int, count: int) -> Column:
    """count values of bits each from one stream of bits; missing longs are zero."""
    mask = (1 << bits) - 1
    low = f"shiftrightunsigned(coalesce(get({name}, cast(i * {bits} div 64 as int)), 0L), cast(i * {bits} % 64 as int))"
    high = f"shiftleft(coalesce(get({name}, cast(i * {bits} div 64 as int) + 1), 0L), cast(64 - i * {bits} % 64 as int))"
    return F.expr(
        f"transform(sequence(0, {count - 1}), i -> cast(({low} | case when i * {bits} % 64 > {64 - bits} then {high} else 0L end) & {mask} as int))"
    )


def unpack(name: str, bits: int, count: int) -> Column:
    """Aligned if there are enough longs for that, else a stream."""
    need = -(-count // (64 // bits))
    return F.when(F.size(name) >= need, unpack_aligned(name, bits, count)).otherwise(unpack_stream(name, bits, count))


def unpack_array(longs: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The same over an int64 array."""
    longs = np.asarray(longs, dtype=np.int64).view(np.uint64)
    each = 64 // bits
    if len(longs) >= -(-count // each):
        shift = (np.arange(each) * bits).astype(np.uint64)
        values = (longs[: -(-count // each), None] >> shift) & np.uint64((1 << bits) - 1)
        return values.ravel()[:count].astype(np.int64)
    stream = np.unpackbits(longs.view(np.uint8), bitorder="little")
    stream = np.concatenate([stream, np.zeros(max(0, count * bits - len(stream)), dtype=np.uint8)])[: count * bits]
    return stream.reshape(count, bits) @ (1 << np.arange(bits, dtype=np.int64))


def palette_bits(size: int) -> int:
    """Bits of a palette index."""
    return max(4, (max(size, 2) - 1).bit_length())
