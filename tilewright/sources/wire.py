"""Fields of protocol-buffer messages: varints, zigzag numbers, packed lists and framed blobs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field; varints as they are, fixed ones as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            if kind == 2:
                size, at = varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"unknown wire type {kind}")
            if at + size > len(data):
                raise ValueError("block ends inside a field")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def unzigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def zigzag(v: int) -> int:
    return (v << 1) ^ (v >> 63) if v >= 0 else ((-v) << 1) - 1


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def packed(data: bytes) -> np.ndarray:
    """Unsigned values of a packed field, all at once."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def packed_deltas(data: bytes) -> np.ndarray:
    v = packed(data)
    return np.cumsum((v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64))


def put(out: bytearray, value: int) -> None:
    value &= (1 << 64) - 1
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)


def field(number: int, value: int | bytes) -> bytes:
    out = bytearray()
    if isinstance(value, int):
        put(out, number << 3)
        put(out, value)
        return bytes(out)
    put(out, number << 3 | 2)
    put(out, len(value))
    return bytes(out) + value


def many(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        put(out, v)
    return bytes(out)


def deltas(values: list[int]) -> bytes:
    return many([zigzag(b - a) for a, b in zip([0, *values], values)])


def open_blob(data: bytes) -> bytes:
    """Content of a blob, plain or compressed with zlib. Any other compression, and a size that isn't the stated one, is an error."""
    content, stated, other = None, None, []
    for number, value in fields(data):
        if number == 1:
            content = value
        elif number == 2:
            stated = value
        elif number == 3:
            content = zlib.decompress(value)
        else:
            other.append(number)
    if content is None:
        raise ValueError(f"blob without plain or zlib content (fields {other})" if other else "empty blob")
    if stated is not None and stated != len(content):
        raise ValueError(f"blob of {len(content)} bytes that should have {stated}")
    return content


def frame(kind: str, data: bytes) -> bytes:
    blob = field(2, len(data)) + field(3, zlib.compress(data))
    head = field(1, kind.encode()) + field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def blob_of_frame(data: bytes) -> tuple[str, bytes]:
    """(kind, blob) of a whole frame."""
    size = struct.unpack(">I", data[:4])[0]
    head = dict(fields(data[4 : 4 + size]))
    return head.get(1, b"").decode(), data[4 + size : 4 + size + head.get(3, 0)]
