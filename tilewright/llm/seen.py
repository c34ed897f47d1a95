"""A map of hashes in bits: a filter ahead of a join, of bounded size however many hashes there are."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 32 for each hash, within these powers of 2 (4 KB to 32 MB).
LEAST_BITS, MOST_BITS = 15, 28


def hash_of(text: str) -> int:
    """The engine's ``xxhash64`` of a text, as an unsigned number."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)


class Seen:
    """A hash that the map lacks doesn't occur; one that it has may. Beyond MOST_BITS / 32 hashes it has more of the others, so the
    join behind it gets more rows to drop, but loses none."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.mask = (1 << bits) - 1
        self.map = np.zeros(max(4096, 1 << (bits - 3)), np.uint8)
        for at, part in parts.items():
            self.map[at * 4096 : at * 4096 + len(part)] = np.frombuffer(part, np.uint8)

    @classmethod
    def of(cls, hashes: DataFrame, count: int, *, most_bits: int | None = None) -> Seen:
        """The map of the bigint column ``h``. It is made by the cluster in parts of 4 KB; all parts together are bounded by MOST_BITS."""
        bits = min(most_bits or MOST_BITS, max(LEAST_BITS, (32 * max(1, count) - 1).bit_length()))
        at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
        parts = hashes.where("h is not null").select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
        return cls(bits, {r["part"]: bytes(r["map"]) for r in parts.toLocalIterator()})

    def may_have(self, text: str) -> bool:
        at = hash_of(text) & self.mask
        return bool(self.map[at >> 3] >> (at & 7) & 1)

    def may_have_all(self, hashes: np.ndarray) -> np.ndarray:
        """For each of the hashes (int64) whether it may occur."""
        at = hashes & self.mask
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
