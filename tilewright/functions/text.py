"""Dates, names and packed forms of tags and keys."""

from __future__ import annotations

import calendar
import re
import struct
import time

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMS = (r"(\d{4})(\d\d)(\d\d)", r"(\d{4})-(\d\d)-(\d\d)", r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)Z?", r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d)-(\d\d)-(\d\d)")


def read_date(text: str | None) -> int:
    """Epoch seconds (UTC) of a day or time, with or without hyphens; 0 if it is none."""
    for form in _FORMS:
        match = re.fullmatch(form, (text or "").strip())
        if match:
            parts = [*map(int, match.groups()), 0, 0, 0][:6]
            try:
                seconds = calendar.timegm((*parts, 0, 0, 0))
                return seconds if time.gmtime(seconds)[:6] == tuple(parts) else 0
            except (ValueError, OverflowError):
                return 0
    return 0


def date_text(seconds: Column) -> Column:
    """Time as ``yyyy-MM-ddTHH:mm:ss`` (UTC)."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")


def file_name(prefix: str, seconds: int, ending: str = ".pbfc") -> str:
    """Name of a delta file of a day, or of a time if it isn't midnight."""
    at = time.gmtime(seconds)
    return prefix + time.strftime("%Y%m%d" if at[3:6] == (0, 0, 0) else "%Y-%m-%dT%H-%M-%S", at) + ending


def read_state(text: str) -> dict[str, int]:
    """``sequence`` and ``timestamp`` of a replication state file."""
    lines = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
    return {"sequence": int(lines["sequenceNumber"]), "timestamp": read_date(lines["timestamp"].replace("\\:", ":").strip())}


def change_file_path(sequence: int) -> str:
    """Path of a change file below its source: three groups of three digits."""
    digits = f"{sequence:09}"
    return f"{digits[:3]}/{digits[3:6]}/{digits[6:]}.osc.gz"


def number_text(v: float, width: int = 10) -> str:
    """A count with spaces between thousands, right-aligned."""
    return f"{v:,.0f}".replace(",", " ").rjust(width)


def short_key(qt: Column) -> Column:
    """A key of fewer than 20 levels in 48 bits; 0 stands for null and -1."""
    depth = qt.bitwiseAND(F.lit(31).cast("bigint"))
    return F.when(qt >= 0, F.shiftleft(F.shiftright(qt, 23), 5).bitwiseOR(depth) + 1).otherwise(F.lit(0).cast("bigint"))


def long_key(short: Column) -> Column:
    v = short - 1
    return F.when(short > 0, F.shiftleft(F.shiftright(v, 5), 23).bitwiseOR(v.bitwiseAND(F.lit(31).cast("bigint")))).otherwise(F.lit(-1).cast("bigint"))


def packed_tags(tags: Column) -> Column:
    """Binary tags: for each key and value two bytes of length (big-endian) and its UTF-8 bytes."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        texts = lambda row: (v.encode() for t in row for v in (t["key"] or "", t["val"] or ""))
        return pa.array([None if row is None else b"".join(struct.pack(">H", len(b)) + b for b in texts(row)) for row in lists.to_pylist()], pa.binary())

    return pack(tags)


def unpacked_tags(data: Column) -> Column:
    """Tags of ``packed_tags``; bytes that end inside a text are an error."""

    @F.arrow_udf("array<struct<key:string,val:string>>")
    def unpack(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            raw, at, texts = row.as_py(), 0, []
            while raw is not None and at < len(raw):
                end = at + 2 + int.from_bytes(raw[at : at + 2], "big")
                if at + 2 > len(raw) or end > len(raw):
                    raise ValueError("packed tags end inside a text")
                texts.append(raw[at + 2 : end].decode("utf-8", "replace"))
                at = end
            if len(texts) % 2:
                raise ValueError("packed tags end inside a tag")
            out.append(None if raw is None else [{"key": k, "val": v} for k, v in zip(texts[::2], texts[1::2])])
        return pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("val", pa.string())])))

    return unpack(data)


def packed_hstore(tags: Column) -> Column:
    """Binary hstore: the number of tags, then for each the lengths (four bytes) and bytes of key and value; -1 for a null value."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        part = lambda v: struct.pack(">i", -1) if v is None else struct.pack(">i", len(v.encode())) + v.encode()
        return pa.array([None if row is None else struct.pack(">i", len(row)) + b"".join(part(t["key"]) + part(t["val"]) for t in row) for row in lists.to_pylist()], pa.binary())

    return pack(tags)
