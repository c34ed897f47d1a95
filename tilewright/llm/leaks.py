"""Passages of held-out test items inside training texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.seen import Seen, hash_of
from tilewright.plans.lineage import cut

#: Markup tags and character entities, which count as blanks.
NOISE = re.compile(r"</?[^\W\d_][^<>]*>|\[/?[^\W\d_][^\[\]]*\]|&#?[0-9A-Za-z]{1,10};")
WORD = re.compile(r"[^\W_]+")
#: Words of a seed, and of the window that must hold one.
SEED, WINDOW = 6, 13
#: Test items handled at a time where documents are compared with every item; what is sent to the executors is bounded by so many items'
#: words. The items and words of a part of them that has its own tables.
COMPARED_A_BLOCK, ITEMS_A_PART, WORDS_A_PART = 2_000, 256, 65_536
MATCH, MISMATCH, GAP = 2, -1, -1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words of a text: runs of letters and digits without case; tags and entities count as blanks."""
    return [w.casefold() for w in WORD.findall(NOISE.sub(" ", text))] if text else []


_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    out = _hashes.get(word)
    if out is None:
        if len(_hashes) > 1_000_000:
            _hashes.clear()
        n = hash_of(word)
        out = _hashes[word] = n - (1 << 64) if n >> 63 else n
    return out


def _seed_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of the SEED words from each position on (int64); fewer words have none."""
    n = len(hashes) - SEED + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key, words = np.zeros(n, np.uint64), hashes.view(np.uint64)
    for k in range(SEED):
        key = (key ^ words[k : k + n]) * _ODD
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), kind))


class ItemBlock:
    """Word codes of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.code: dict[str, int] = {}
        self.items = [(i, np.array([self.code.setdefault(w, len(self.code)) for w in words_of(text)], np.int64)) for i, text in items]

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words of all texts, each text followed by SEED words without a code; where each text starts."""
        code, flat, starts = self.code, [], []
        gap = [-1] * SEED
        for text in texts:
            starts.append(len(flat))
            flat += [code.get(w, -1) for w in words_of(text.as_py())]
            flat += gap
        return np.array(flat, np.int64), np.array([*starts, len(flat)], np.int64)


def align_all(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score, and longest run of equal consecutive words, of each passage and the item beside it.

    All pairs advance by one word of their passages at a time; shorter ones are filled up with words that equal nothing.
    """
    height, width = max(map(len, passages), default=0), max(map(len, items), default=0)
    rows, columns = np.full((height, len(items)), -2, np.int64), np.full((len(items), width), -3, np.int64)
    for k, (passage, item) in enumerate(zip(passages, items)):
        rows[: len(passage), k] = passage
        columns[k, : len(item)] = item
    score, run = np.zeros((len(items), width + 1), np.int32), np.zeros((len(items), width + 1), np.int32)
    best, longest = np.zeros_like(score), np.zeros_like(run)
    ramp = (-GAP * np.arange(width + 1)).astype(np.int32)
    for words in rows:
        equal = columns == words[:, None]
        row = score + np.int32(GAP)
        np.maximum(row[:, 1:], score[:, :-1] + np.where(equal, np.int32(MATCH), np.int32(MISMATCH)), out=row[:, 1:])
        np.maximum(row, 0, out=row)
        row += ramp
        score = np.maximum.accumulate(row, axis=1) - ramp
        run[:, 1:] = (run[:, :-1] + 1) * equal
        np.maximum(best, score, out=best)
        np.maximum(longest, run, out=longest)
    return best.max(axis=1, initial=0), longest.max(axis=1, initial=0)


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(score, longest run) of one pair."""
    score, run = align_all([passage], [item])
    return int(score[0]), int(run[0])


#: Documents whose words are handled as one array.
SOME = 256
#: Passages that are aligned together, and the words that they may have when filled up to one length.
TOGETHER, CELLS = 64, 1_000_000


def _spans(places: list[int], width: int) -> list[tuple[int, int]]:
    """Stretches around seeds: a passage that holds a seed lies within the item's length of it."""
    out: list[tuple[int, int]] = []
    for at in places:
        lo, hi = max(0, at - width), at + SEED + width
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _scores(jobs: list[tuple], items: list[tuple[int, np.ndarray]]) -> dict[tuple, tuple[int, int]]:
    """Best score and run of the passages of each document and item. Passages of like length are aligned together."""
    best: dict[tuple, tuple[int, int]] = {}
    order = sorted(range(len(jobs)), key=lambda k: len(jobs[k][1]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < min(len(order), lo + TOGETHER) and (hi + 1 - lo) * len(jobs[order[hi]][1]) <= CELLS:
            hi += 1
        some, lo = [jobs[k] for k in order[lo:hi]], hi
        for (pair, _), score, run in zip(some, *align_all([p for _, p in some], [items[pair[2]][1] for pair, _ in some])):
            old = best.get(pair, (0, 0))
            best[pair] = (max(old[0], int(score)), max(old[1], int(run)))
    return best


def _rows(best: dict[tuple, tuple[int, int]], items: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """One row for each document and item."""
    out = [(doc_id, items[nth][0], score, run, len(items[nth][1])) for (_, doc_id, nth), (score, run) in sorted(best.items(), key=lambda x: (x[0][0], x[0][2]))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "score", "run", "item_words"])


class ItemPart:
    """Which words, and which pairs of consecutive words, each item of a part has: tables with a row for each of them."""

    def __init__(self, nths: list[int], words: list[np.ndarray], n_codes: int):
        self.nths = np.array(nths, np.int64)
        used = np.unique(np.concatenate(words))
        self.local = np.full(n_codes + 1, len(used), np.int64)  # of code -1 too
        self.local[used] = np.arange(len(used))
        pairs = [self.local[w[:-1]] * (len(used) + 1) + self.local[w[1:]] for w in words]
        self.pairs = np.unique(np.concatenate(pairs))
        self.has_word = np.zeros((len(used) + 1, len(words)), np.int8)
        self.has_pair = np.zeros((len(self.pairs) + 1, len(words)), np.int8)
        for k, (w, p) in enumerate(zip(words, pairs)):
            self.has_word[self.local[w], k] = 1
            self.has_pair[np.searchsorted(self.pairs, p), k] = 1

    def spans(self, texts: list[np.ndarray], least: int) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to) wherever an alignment of the text and the item may score ``least``: one that does lies inside.

        A word that the item has adds MATCH, another one takes GAP. Two words in a row that the item has, but not in a
        row, can't both be matched without a gap. So no alignment scores more than the greatest sum of a stretch.
        """
        n = np.array([len(t) for t in texts])  # longest first
        height = int(n[0])
        at = np.full((height + 1, len(texts)), len(self.has_word) - 1, np.int64)
        for k, t in enumerate(texts):
            at[1 : len(t) + 1, k] = self.local[t]
        pair = at[:-1] * len(self.has_word) + at[1:]
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        found = np.where(self.pairs[found] == pair, found, len(self.pairs))
        at = at[1:]
        kind = np.int16 if MATCH * height < 32_000 else np.int32
        total = np.zeros((len(texts), len(self.nths)), kind)
        best, before = np.zeros_like(total), np.zeros(total.shape, np.int8)
        for t in range(height):
            m = int(np.searchsorted(-n, -t, "left"))  # texts that go on
            now, sums = self.has_word[at[t, :m]], total[:m]
            sums += now * np.int8(MATCH - GAP) + np.int8(GAP) + (self.has_pair[found[t, :m]] - (before[:m] & now)) * np.int8(-GAP)
            np.maximum(sums, 0, out=sums)
            np.maximum(best[:m], sums, out=best[:m])
            before = now
        which, item = np.nonzero(best >= least)
        # again for these only: from where the first stretch that reaches ``least`` begins to where the last one holds it
        total, before = np.zeros(len(which), np.int64), np.zeros(len(which), np.int8)
        begin, first, last = np.zeros(len(which), np.int64), np.full(len(which), -1), np.zeros(len(which), np.int64)
        for t in range(height):
            m = int(np.searchsorted(which, np.searchsorted(-n, -t, "left")))
            if not m:
                break
            begin[:m][total[:m] == 0] = t
            now, sums = self.has_word[at[t, which[:m]], item[:m]], total[:m]
            sums += now * np.int8(MATCH - GAP) + np.int8(GAP) + (self.has_pair[found[t, which[:m]], item[:m]] - (before[:m] & now)) * np.int8(-GAP)
            np.maximum(sums, 0, out=sums)
            reached = sums >= least
            first[:m] = np.where(reached & (first[:m] < 0), begin[:m], first[:m])
            last[:m][reached] = t
            before = now
        return list(zip(which.tolist(), self.nths[item].tolist(), first.tolist(), (last + 1).tolist()))


def _compare(block: ItemBlock, least: int):
    def parts() -> Iterator[ItemPart]:
        nths, words, total = [], [], 0
        for nth, (_, w) in enumerate(block.items):
            if MATCH * len(w) < least or len(w) < 2:
                continue
            if words and (len(words) == ITEMS_A_PART or total + len(w) > WORDS_A_PART):
                yield ItemPart(nths, words, len(block.code))
                nths, words, total = [], [], 0
            nths.append(nth)
            words.append(w)
            total += len(w)
        if words:
            yield ItemPart(nths, words, len(block.code))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, items = list(parts()), block.items
        for batch in batches:
            for lo in range(0, batch.num_rows if tables else 0, SOME):
                doc_ids = batch.column("doc_id").slice(lo, SOME).to_pylist()
                codes, starts = block.codes(batch.column("text").slice(lo, SOME))
                texts = [codes[a : b - SEED] for a, b in zip(starts[:-1], starts[1:])]
                order = sorted((k for k, t in enumerate(texts) if MATCH * len(t) >= least), key=lambda k: -len(texts[k]))
                jobs, some = [], 0
                while some < len(order):
                    group = order[some : some + max(1, CELLS // len(texts[order[some]]))]
                    some += len(group)
                    for part in tables:
                        jobs.extend(((group[k], doc_ids[group[k]], nth), texts[group[k]][a:b]) for k, nth, a, b in part.spans([texts[k] for k in group], least))
                scored = _scores(jobs, items)
                # the longest run may lie elsewhere in the text
                kept = _scores([(pair, texts[pair[0]]) for pair, (score, _) in scored.items() if score >= least], items)
                if kept:
                    yield _rows(kept, items)

    return compare


def edited_items(documents: DataFrame, items: DataFrame, least: int = MATCH * WINDOW) -> DataFrame:
    """(doc_id, item_id, score, run, item_words) of each document and item whose best alignment scores at least ``least``.

    Tables and columns as in ``leaked_items``; ``run`` is the longest in the whole document. ``least`` is at least 3.

    An edited copy need not share any n-gram with its item, so there are no seeds: every document is compared with
    every item by an upper bound of their score, which takes a step a word for many documents and items at once.
    Only what the bound admits is aligned. Items go in blocks of COMPARED_A_BLOCK.
    """
    return _by_block(documents, items, COMPARED_A_BLOCK, lambda texts, some: texts.mapInArrow(_compare(ItemBlock(some), least), FOUND))


FOUND = "doc_id bigint, item_id bigint, score bigint, run bigint, item_words bigint"


def _by_block(documents: DataFrame, items: DataFrame, size: int, run) -> DataFrame:
    """Union of what ``run`` makes of the documents and each block of items."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    block: list[tuple[int, str]] = []
    for row in items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text")).toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == size:
            part = run(texts, block)
            found, block = part if found is None else found.unionByName(part), []
    if block or found is None:
        part = run(texts, block)
        found = part if found is None else found.unionByName(part)
    return found


ITEM_WORDS = "item_id bigint, words array<bigint>, keys array<bigint>"


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [np.array([_hash(w) for w in words_of(t.as_py())], np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), _lists(words, pa.int64()), _lists([_seed_keys(w) for w in words], pa.int64())], names=["item_id", "words", "keys"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every WINDOW consecutive words of an item (of the item, if it is shorter) the n-gram rarest in the corpus; of equals one
    serves as many windows as it can. One that is in no document is no seed: neither is a window with it."""
    for batch in batches:
        items, seeds = [], []
        for item, grams in zip(batch.column("item_id").to_pylist(), batch.column("grams")):
            flat = grams.values
            keys, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
            width = min(WINDOW - SEED + 1, len(keys))
            best, chosen = -1, set()
            for lo in range(len(keys) - width + 1):
                least = lo + width - 1 - int(np.argmin(n[lo : lo + width][::-1]))
                if best < lo or n[least] < n[best]:
                    best = least
                    if n[best]:
                        chosen.add(int(keys[best]))
            items += [item] * len(chosen)
            seeds += chosen
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(seeds, pa.int64())], names=["item_id", "key"])


HELD = "doc_id bigint, words array<bigint>, keys array<bigint>, places array<int>"


def _scan(seen):
    """Words of the documents that may hold n-grams of items, with these n-grams and their places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = seen.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SOME):
                ids = batch.column("doc_id").slice(lo, SOME)
                flat: list[int] = []
                ends = [0]
                for text in batch.column("text").slice(lo, SOME):
                    flat += [_hash(w) for w in words_of(text.as_py())]
                    ends.append(len(flat))
                words, ends = np.array(flat, np.int64), np.array(ends)
                keys = _seed_keys(words)
                at = np.flatnonzero(held.may_have_all(keys))
                doc = np.searchsorted(ends, at, side="right") - 1
                whole = at + SEED <= ends[doc + 1]
                at, doc = at[whole], doc[whole]
                if not len(at):
                    continue
                which, first = np.unique(doc, return_index=True)
                parts = np.split(at, first[1:])
                out = [ids.take(pa.array(which)), _lists([words[ends[d] : ends[d + 1]] for d in which], pa.int64()), _lists([keys[p] for p in parts], pa.int64()), _lists([p - ends[d] for d, p in zip(which, parts)], pa.int32())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "words", "keys", "places"])

    return scan


def _align_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids, item_ids, places = (batch.column(c).to_pylist() for c in ("doc_id", "item_id", "places"))
        items = [(i, w.values.to_numpy()) for i, w in zip(item_ids, batch.column("item"))]
        jobs = []
        for k, words in enumerate(batch.column("words")):
            flat = words.values.to_numpy()
            jobs.extend(((k, doc_ids[k], k), flat[a:b]) for a, b in _spans(sorted(places[k]), len(items[k][1])))
        if jobs:
            yield _rows(_scores(jobs, items), items)


def leaked_items(documents: DataFrame, items: DataFrame, *, most_bits: int | None = None) -> DataFrame:
    """(doc_id, item_id, score, run, item_words) of each document and item that share a seed.

    ``documents``: ``doc_id, text``; ``items``: ``item_id, text``. ``score`` is that of the best Smith-Waterman alignment of
    their words (2 for equal words, -1 for a changed, missing or added one), ``run`` the longest run of equal
    consecutive words. Null and empty texts share nothing; items of fewer than SEED words have no seed. Copied
    documents each come out, those without an id too; copied rows of one item come out once. Other columns are ignored.

    All n-grams of SEED words of the items are a table. One scan of the corpus keeps the documents with n-grams that a map of these
    (bounded, see ``seen``) may have; a join with the table counts the n-grams over the whole corpus. The rarest of every WINDOW
    consecutive words of an item are its seeds, so every run of WINDOW words has one. Seeds are joined to the kept n-grams by hash,
    and each joined passage is aligned as far as the item's length reaches. The number of scans and what the driver holds don't grow with the
    items. This is whole for runs of WINDOW words; copies edited more often have no seed where the rarest n-gram is in
    no document (``edited_items`` has no seeds). Words are compared by 64-bit hashes.
    """
    spark = documents.sparkSession
    one = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    tested = cut(one.mapInArrow(_item_words, ITEM_WORDS), "items")
    grams = tested.select("item_id", F.posexplode("keys").alias("pos", "key"))
    distinct = cut(grams.select("key").distinct(), "keys")
    seen = spark.sparkContext.broadcast(Seen.of(distinct.select(F.col("key").alias("h")), distinct.count(), most_bits=most_bits))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held = cut(texts.mapInArrow(_scan(seen), HELD).withColumn("row", F.monotonically_increasing_id()), "held")
    hits = held.select("row", F.explode(F.arrays_zip("keys", "places")).alias("h")).select("row", F.col("h.keys").alias("key"), F.col("h.places").alias("place"))
    counts = held.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counted = grams.join(counts, "key", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", F.coalesce("n", F.lit(0)).alias("n")))).alias("grams"))
    seeds = counted.mapInArrow(_choose, "item_id bigint, key bigint")
    pairs = hits.join(seeds, "key").groupBy("row", "item_id").agg(F.collect_list("place").alias("places"))
    met = pairs.join(tested.select("item_id", F.col("words").alias("item")), "item_id").join(held.select("row", "doc_id", "words"), "row")
    return met.select("doc_id", "item_id", "places", "words", "item").mapInArrow(_align_pairs, FOUND)
