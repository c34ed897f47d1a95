"""Encoding and decoding of texts by a byte-pair tokenizer's merges, as an automaton."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Words whose ids a worker remembers; at this number it starts afresh.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, and its byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(path: str) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """(merges in order, id of every token) of a vocabulary file, JSON with merges or lines of rank files."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        plain = lambda token: bytes(letters[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [(plain(a), plain(b)) for a, b in pairs]
        known = {token for a, b in made for token in (a + b,)} | {bytes([b]) for b in range(256)}
        ids = {}
        for token, i in model["vocab"].items():
            if all(c in letters for c in token) and plain(token) in known:
                ids[plain(token)] = i
        return made, ids
    with open(path, "rb") as file:
        ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    made = []
    for token in sorted((t for t in ids if len(t) > 1), key=ids.get):
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            ranks = [ids.get(a + b, len(ids)) for a, b in zip(parts, parts[1:])]
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        made.append((parts[0], parts[1]))
    return made, ids


class MergeAutomaton:
    """Deterministic automaton over tokens that accepts exactly the sequences which the merges produce.

    Its state is the last token read; the transition on the next token is defined if the two may stand side by side.
    Before any merge, all single bytes may. The gadget of a merge (a, b) -> c takes the transition from a to b away,
    and gives c those into a and out of b that existed before it. Applied in merge order, these gadgets define every
    transition; the table is filled by undoing them from the later token on, at the first use of a transition.

    As each prefix of a word has one accepted sequence, the state after each byte is a single token, found among the
    tokens ending there by one look at the table each. Which tokens end at each byte comes from one pass of a compiled
    matcher of all labels. The arcs' labels, followed back from the last state, are the word's tokens.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.labels = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.number = {}
        for k, label in enumerate(self.labels):
            self.number.setdefault(label, k)
        self.ids = [ids[label] for label in self.labels]
        self.parts = [(k, k) for k in range(256)] + [(self.number[a], self.number[b]) for a, b in merges]
        self.merged = {}
        for k, (a, b) in enumerate(self.parts[256:], 256):
            self.merged.setdefault((a, b), k)
        self.lengths = list(map(len, self.labels))
        self.ends = ahocorasick.Automaton()
        for label, k in self.number.items():
            self.ends.add_word(label.decode("latin-1"), (k, len(label)))
        self.ends.make_automaton()
        self.table: dict[tuple[int, int], bool] = {}

    def step(self, state: int, token: int) -> bool:
        """Whether the automaton goes from ``state`` on by ``token``."""
        found = self.table.get((state, token))
        if found is None:
            if len(self.table) > 4_000_000:
                self.table.clear()
            found = self.table[state, token] = self._undo(state, token)
        return found

    def _undo(self, left: int, right: int) -> bool:
        until = len(self.labels)  # gadgets from this one on do not count
        while True:
            if self.merged.get((left, right), until) < until:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:  # the gadget that made the left token copied the transitions of its second part
                until, left = left, self.parts[left][1]
            else:  # leftmost first: of three equal tokens the first two merge, so the gadget itself counts
                until, right = right + 1, self.parts[right][0]

    def encode_word(self, word: bytes) -> list[int]:
        step = self.step
        states = [-1] * (len(word) + 1)
        for last, (token, size) in self.ends.iter(word.decode("latin-1")):
            start = last + 1 - size
            if states[last + 1] < 0 and (start == 0 or step(states[start], token)):
                states[last + 1] = token
        out, end = [], len(word)
        while end:
            out.append(self.ids[states[end]])
            end -= self.lengths[states[end]]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a token sequence: the labels of its arcs."""
        label = {i: self.labels[k] for k, i in enumerate(self.ids)}
        return b"".join(label[i] for i in ids)


class _Words(dict):
    """Ids of words, made when first needed."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> list[int]:
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(word) < 64:
            self[word] = ids
        return ids


def encode_texts(documents: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every row of ``documents`` (``doc_id``, ``text``), without special tokens.

    Empty and null texts give an empty list; blank text has tokens. Copied rows and null doc_ids come out as they are.
    The strings of special tokens are ordinary text. Other columns are ignored. The vocabulary is read by the driver
    and sent along (its size is that of the file), so executors need not have it.
    """
    merges, ids = read_merges(os.path.join(folder, tokenizer))
    held = {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held["split"] = regex.compile(PATTERN).findall
            held["words"] = _Words(MergeAutomaton(merges, ids))
        split, words = held["split"], held["words"]
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(texts), 512):
                flat: list[int] = []
                ends = [0]
                for text in texts.slice(lo, 512).to_pylist():
                    if text:
                        for word in split(text):
                            flat += words[word]
                    ends.append(len(flat))
                if len(words) > REMEMBERED:
                    words.clear()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, 512), lists], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids): the inverse of ``encode_texts``; null and empty ids give empty text."""
    merges, ids = read_merges(os.path.join(folder, tokenizer))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = MergeAutomaton(merges, ids)
        label = {i: automaton.labels[k] for k, i in enumerate(automaton.ids)}
        for batch in batches:
            texts = [b"".join(label[i] for i in row or ()).decode("utf-8", "replace") for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")
