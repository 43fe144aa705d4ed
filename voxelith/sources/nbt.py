"""Named binary tags: reading what a chunk needs, and writing for tests."""

from __future__ import annotations

import struct

import numpy as np

# Tag numbers of the format.
END, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(13)
_PLAIN = {BYTE: ">b", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}
_ARRAYS = {BYTES: ">i1", INTS: ">i4", LONGS: ">i8"}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        value = struct.unpack_from(form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return value

    def text(self) -> str:
        size = self.take(">H")
        if self.at + size > len(self.data):
            raise ValueError("the text ends early")
        self.at += size
        return self.data[self.at - size : self.at].decode("utf-8", "replace")

    def value(self, tag: int):
        if tag in _PLAIN:
            return self.take(_PLAIN[tag])
        if tag in _ARRAYS:
            size = self.take(">i")
            found = np.frombuffer(self.data, dtype=_ARRAYS[tag], count=size, offset=self.at)
            self.at += found.nbytes
            return found.astype(found.dtype.newbyteorder("="))
        if tag == STRING:
            return self.text()
        if tag == LIST:
            kind, size = self.take(">B"), self.take(">i")
            return [self.value(kind) for _ in range(size)]
        if tag == COMPOUND:
            out = {}
            while (kind := self.take(">B")) != END:
                name = self.text()
                out[name] = self.value(kind)
            return out
        raise ValueError(f"unknown tag {tag}")


def parse(data: bytes) -> dict | None:
    """The root compound; None if the data is no whole compound."""
    try:
        reader = _Reader(data)
        if reader.take(">B") != COMPOUND:
            return None
        reader.text()
        return reader.value(COMPOUND)
    except (ValueError, struct.error, IndexError):
        return None


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack(">H", len(raw)) + raw


def _tag(value) -> int:
    if isinstance(value, bool):
        return BYTE
    if isinstance(value, int):
        return INT
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, str):
        return STRING
    if isinstance(value, dict):
        return COMPOUND
    if isinstance(value, bytes):
        return BYTES
    if isinstance(value, np.ndarray):
        return LONGS if value.dtype.itemsize == 8 else INTS
    if isinstance(value, list):
        return LIST
    raise TypeError(type(value))


def _body(value) -> bytes:
    tag = _tag(value)
    if tag in _PLAIN:
        return struct.pack(_PLAIN[tag], value)
    if tag == STRING:
        return _text(value)
    if tag == BYTES:
        return struct.pack(">i", len(value)) + value
    if tag in (INTS, LONGS):
        return struct.pack(">i", len(value)) + value.astype(_ARRAYS[tag]).tobytes()
    if tag == LIST:
        return struct.pack(">Bi", _tag(value[0]) if value else END, len(value)) + b"".join(map(_body, value))
    return b"".join(struct.pack(">B", _tag(v)) + _text(k) + _body(v) for k, v in value.items()) + b"\x00"


def dump(root: dict) -> bytes:
    """A root compound without a name."""
    return struct.pack(">B", COMPOUND) + _text("") + _body(root)
