"""Occurrences and record counts of every distinct term of a collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.lineage import cut

#: A block's arrays are given out when its dictionary reaches so many terms, which bounds a task's memory.
BLOCK_TERMS = 400_000


class _Block:
    """Dictionary and count arrays of one block of records."""

    def __init__(self) -> None:
        self.ids: dict[tuple[str, str], int] = {}
        self.arrays = [np.zeros(1024, np.int64), np.zeros(1024, np.int64)]
        self.records = 0

    def add(self, parents: np.ndarray, keys: pa.Array, vals: pa.Array) -> None:
        keys, vals = keys.dictionary_encode(), vals.dictionary_encode()
        width = max(1, len(vals.dictionary))
        pairs = keys.indices.to_numpy().astype(np.int64) * width + vals.indices.to_numpy()
        distinct, codes = np.unique(pairs, return_inverse=True)
        names, values = keys.dictionary.to_pylist(), vals.dictionary.to_pylist()
        own = np.array([self.ids.setdefault((names[p // width], values[p % width]), len(self.ids)) for p in distinct.tolist()], np.int64)
        if len(self.ids) > len(self.arrays[0]):
            self.arrays = [np.concatenate([a, np.zeros(2 * len(self.ids) - len(a), np.int64)]) for a in self.arrays]
        per_record = np.unique(parents.astype(np.int64) * len(distinct) + codes) % max(1, len(distinct))
        for array, found in zip(self.arrays, (codes, per_record)):
            array[own] += np.bincount(found, minlength=len(distinct))

    def rows(self) -> pa.RecordBatch:
        """One row per term; the number of records with any term is in the row with null term."""
        n = len(self.ids)
        terms = [(None, None), *self.ids]
        counts = [[self.records, *a[:n].tolist()] for a in self.arrays]
        return pa.RecordBatch.from_arrays([pa.array([t[0] for t in terms], pa.string()), pa.array([t[1] for t in terms], pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["key", "val", "occurrences", "records"])


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches:
        lists = batch.column("terms")
        if not isinstance(lists, pa.ListArray):
            lists = lists.cast(pa.list_(lists.type.value_type))
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        block.records += int((lengths > 0).sum())
        flat = lists.flatten()
        parents = np.repeat(np.arange(len(lengths)), lengths)
        keys, vals = pc.struct_field(flat, 0), pc.struct_field(flat, 1)
        known = pc.and_(keys.is_valid(), vals.is_valid())
        block.add(parents[known.to_numpy(zero_copy_only=False)], keys.filter(known), vals.filter(known))
        if len(block.ids) >= BLOCK_TERMS:
            yield block.rows()
            block = _Block()
    if block.records or block.ids:
        yield block.rows()


def term_frequencies(records: DataFrame, terms: str) -> tuple[DataFrame, int]:
    """((key, val, occurrences, records) of every distinct term, number of records with any term).

    ``records``: one row per record; ``terms`` an array of structs of two strings, the term's key and value. Terms are
    compared exactly as stored; those with a null part are left out, empty strings are not; null and empty arrays
    hold none. The record number counts every record whose array isn't empty. Other columns are ignored.

    Each block of records (a task's rows) accumulates count arrays over a dictionary of its own. A global integer
    dictionary is built of all blocks' terms; blocks' terms are encoded with it; arrays over each range of ids sum the
    blocks' counts. A term is shuffled once per block, however often it occurs.
    """
    blocks = cut(records.select(F.col(terms).alias("terms")).mapInArrow(_count_blocks, "key string, val string, occurrences bigint, records bigint"), "blocks")
    total = blocks.where("key is null and val is null").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    blocks = blocks.where("key is not null and val is not null")
    # Ids are dense within a partition of the dictionary, so each partition is one range of ids.
    dictionary = cut(blocks.select("key", "val").distinct().withColumn("term_id", F.monotonically_increasing_id()), "dictionary")
    encoded = blocks.join(dictionary, ["key", "val"]).select(F.shiftright("term_id", 33).alias("range"), "term_id", "occurrences", "records")

    def sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            which, ids, *counts = (batch.column(c).to_numpy() for c in ("range", "term_id", "occurrences", "records"))
            for r in np.unique(which).tolist():
                here = which == r
                at = ids[here] & ((1 << 33) - 1)
                held = sums.setdefault(r, [np.zeros(0, np.int64), np.zeros(0, np.int64)])
                for k, found in enumerate(counts):
                    if len(held[k]) <= at.max():
                        held[k] = np.concatenate([held[k], np.zeros(int(at.max()) + 1 - len(held[k]) // 2, np.int64)])
                    np.add.at(held[k], at, found[here])
        for r, (occurrences, present) in sums.items():
            at = np.flatnonzero(present)
            yield pa.RecordBatch.from_arrays([pa.array(at + (r << 33)), pa.array(occurrences[at]), pa.array(present[at])], names=["term_id", "occurrences", "records"])

    summed = encoded.repartition("range").mapInArrow(sum_ranges, "term_id bigint, occurrences bigint, records bigint")
    return summed.join(dictionary, "term_id").select("key", "val", "occurrences", "records"), total


def marked_terms(records: DataFrame, terms: str, *, rare_below: int = 3, common_share: int = 20) -> DataFrame:
    """Terms with ``mark``: ``rare`` if in fewer than ``rare_below`` records, ``common`` if in at least one of
    ``common_share`` of the records with any term (rare goes first), else null; with their counts."""
    found, total = term_frequencies(records, terms)
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_share >= F.lit(total), "common")
    return found.withColumn("mark", mark)
