import os
import random

import pytest

from tilewright.llm.tokenize import TOKENIZERS, MergeAutomaton, decode_ids, encode_texts, read_merges

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZERS, "byte_bpe_50k.json")), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(11)
    pools = ["abcdefghij etaoin", "äöüß é’“”–€ 日本語 Граница 🙂👩‍🌾", " \n\t\xa0", "0123456789.,;:'!?", "aaaaaaab", "<|endoftext|>"]
    out = ["", " ", "  \n ", "<|endoftext|>", "it's 'S we'LL", "a" * 3000, "-" * 500, "abababab" * 40, "́🗺️", "\x00\x7f"]
    for _ in range(300):
        out.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 120))))
    return out


def test_ids_equal_the_library(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(900, None, "y"), (None, "hello", "z"), (5, " ", "copy"), (5, " ", "copy")]
    got = encode_texts(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if k is None else k, library(t) if t else []) for k, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == want


def test_round_trip(spark):
    some = texts()
    encoded = encode_texts(spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string"))
    assert [r.text for r in decode_ids(encoded).orderBy("doc_id").collect()] == some


def test_rank_files_give_the_same_automaton():
    automata = [MergeAutomaton(*read_merges(os.path.join(TOKENIZERS, f"byte_bpe_50k.{kind}"))) for kind in ("json", "tiktoken")]
    for word in " the quick Straße 1234567 naïve aaaaaaa".split(" "):
        one, two = (a.encode_word(word.encode()) for a in automata)
        assert one == two and automata[0].decode(one) == word.encode()


def test_every_accepted_sequence_is_what_the_merges_give():
    """A tiny vocabulary, against merging step by step."""
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"a"), (b"b", b"a"), (b"ab", b"ab"), (b"aa", b"ab"), (b"c", b"c"), (b"cc", b"c")]
    ids = {bytes([b]): b for b in range(256)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
    automaton = MergeAutomaton(merges, ids)

    def stepwise(word):
        parts = [word[k : k + 1] for k in range(len(word))]
        for a, b in merges:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == (a, b):
                    parts[k : k + 2] = [a + b]
                k += 1
        return [ids[p] for p in parts]

    rng = random.Random(1)
    for _ in range(2000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        assert automaton.encode_word(word) == stepwise(word), word


def test_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
