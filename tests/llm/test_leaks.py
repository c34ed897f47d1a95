import random

import numpy as np
import pytest

from tilewright.llm import leaks, seen
from tilewright.llm.leaks import align, leaked_items, words_of
from tilewright.llm.queries import p9_edited

DOCS, ITEMS = "doc_id bigint, text string, item_id string, score int", "item_id bigint, text string, doc_id int"


def found(spark, docs, items):
    one = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    two = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    return [tuple(r) for r in leaked_items(one, two).collect()]


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_words_go_on_across_markup():
    assert words_of('One [b]two[/b]-three&nbsp;<a href="x y">FOUR</a>\n> fi&amp;ve_Straße &toolongtobeanentity; a<5 [1]') == ["one", "two", "three", "four", "fi", "ve", "strasse", "toolongtobeanentity", "a", "5", "1"]
    assert words_of(None) == words_of("") == words_of(" \n") == []


@pytest.mark.parametrize("bits", [28, 10])
def test_every_run_of_thirteen_is_found(spark, monkeypatch, bits):
    monkeypatch.setattr(seen, "LEAST_BITS", 10)  # so that a map of few bits lets n-grams through that no item has
    monkeypatch.setattr(seen, "MOST_BITS", bits)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, sentence(rng.choice([5, 12, 13, 30, 60]))) for k in range(7)]
    items.append((50, items[3][1]))  # two items share a passage
    docs = []
    for k in range(150):
        i, words = rng.choice(items)
        n = rng.choice([0, 6, 12, 13, 14, len(words)])
        at = rng.randrange(max(1, len(words) - n + 1))
        docs.append((k, sentence(rng.randrange(30)) + words[at : at + n] + sentence(rng.randrange(30))))
    got = found(spark, [(k, " ".join(w).upper()) for k, w in docs], [(i, ". ".join(w)) for i, w in items])
    assert len({r[:2] for r in got}) == len(got)
    runs = {(d, i): run for d, i, _, run, _ in got}
    want = {(d, i): longest(a, b) for d, a in docs for i, b in items}
    assert {k for k, n in runs.items() if n >= 13} == {k for k, n in want.items() if n >= 13}
    assert all(want[k] == n for k, n in runs.items() if n >= 13)


def test_alignment_scores_edited_copies():
    item = np.arange(20)
    assert align(item, item) == (40, 20)
    assert align(np.delete(item, 10), item) == (37, 10)
    assert align(np.where(item == 5, -1, item), item) == (37, 14)
    assert align(np.array([], np.int64), item) == (0, 0)


def test_nulls_copies_and_long_texts(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = [(1, None), (2, ""), (3, "  "), (None, passage), (4, passage), (4, passage), (5, "x " * 200_000 + passage + " y" * 1000)]
    items = [(7, passage), (7, passage), (8, None), (9, ""), (None, passage), (10, "too short")]
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:4]) for r in found(spark, docs, items))
    assert got == [(-1, 7, 40, 20), (4, 7, 40, 20), (4, 7, 40, 20), (5, 7, 40, 20)]


def test_empty_tables(spark):
    assert found(spark, [], []) == found(spark, [(1, "a b c")], []) == found(spark, [], [(1, "a b c d e f g h i j k l m n")]) == []


def smith_waterman(a, b):
    score, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        score, before = max(score, *row), row
    return score


def test_edited_copies_equal_brute_force(spark, tmp_path):
    rng = random.Random(19)
    vocabulary = [f"w{k}" for k in range(60)]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: [f"i{k}x{j}" if rng.random() < 0.5 else rng.choice(vocabulary) for j in range(rng.choice([5, 12, 13, 14, 40, 70]))] for k in range(9)}
    docs = []
    for _ in range(70):
        every, words = rng.choice([2, 3, 4, 7, 9, 12, 99]), []
        for j, w in enumerate(rng.choice(list(items.values())), 1):  # an edit at least every so many words
            words += [w] if j % every else rng.choice([[], ["new"], [w, "new"]])
        docs.append(sentence(rng.randrange(60)) + words + sentence(rng.randrange(60)))
    docs += [[], ["w1"] * 40_000, items[max(items, key=lambda k: len(items[k]))][:9] * 30]
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {(r.doc_id, r.item_id): (r.score, r.run) for r in p9_edited(spark, str(tmp_path)).collect()}
    want = {(d, i): s for d, a in enumerate(docs) for i, b in items.items() if len(a) < 40_000 and (s := smith_waterman(a, b)) >= 26}
    assert {k: s for k, (s, _) in got.items()} == want
    assert any(longest(docs[d], items[i]) < 6 for d, i in want)
    assert all(run == longest(docs[d], items[i]) for (d, i), (_, run) in got.items())


def test_copies_with_every_nth_word_changed(spark):
    """Planted copies of passages of 60 words, a word changed in every 4 to 8: all of them are found, with the score of the alignment."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = {k: [rng.choice(vocabulary) for _ in range(60)] for k in range(12)}
    docs = []
    for k in range(96):
        words = list(items[k % 12])
        for at in range(rng.randrange(4), 60, 4 + k % 5):
            words[at] = f"new{at}"
        docs.append([rng.choice(vocabulary) for _ in range(50)] + words + [rng.choice(vocabulary) for _ in range(50)])
    one = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id bigint, text string")
    two = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in leaks.edited_items(one, two, 26).collect()}
    assert set(got) == {(k, k % 12) for k in range(96)}
    assert all(got[k, i] == smith_waterman(docs[k], items[i]) for k, i in list(got)[::7])
