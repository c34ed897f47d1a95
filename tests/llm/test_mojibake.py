import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm.mojibake import garbled_documents, garbled_lists, garbled_words, restored_documents, undo_utf8
from tilewright.llm.seen import Seen, hash_of

CLEAN = ["Das Gebäude steht über der Straße.", "Le sentier est étroit, déjà signalé – l’allée.", "Граница района идёт через старый памятник.", "Zażółć granicę na mapie, proszę, już łąka.", "ATENÇÃO: IRMÃ, AMANHÃ VEJO O MAPÃO", "“No lock” costs 5 € \U0001f642", "線路の名前を直しました、確認してください。"]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, form string, kind int")


def corpus():
    return CLEAN * 30


GARBLED = [
    (CLEAN[0].encode().decode("cp1252"), CLEAN[0]),
    (CLEAN[0].encode().decode("latin-1"), CLEAN[0]),
    (CLEAN[0].encode().decode("cp437"), CLEAN[0]),
    (CLEAN[1].encode().decode("mac_roman"), CLEAN[1]),
    (CLEAN[1].encode().decode("cp1251"), CLEAN[1]),
    (CLEAN[0].encode().decode("latin-1").encode().decode("cp1252", "replace"), None),
    (CLEAN[3].encode("cp1250").decode("latin-1"), CLEAN[3]),
    (CLEAN[2].encode("koi8-r").decode("cp1251"), CLEAN[2]),
    (CLEAN[2].encode("cp1251").decode("cp1252"), CLEAN[2]),
    (CLEAN[0].encode("cp1252").decode("utf-8", "replace"), CLEAN[0]),
    ("Fine here. " + "Straße".encode().decode("cp1252"), "Fine here. Straße"),
]


@pytest.fixture(scope="module")
def results(spark):
    texts = corpus() + [g for g, _ in GARBLED] + [None, "", " ", "plain ASCII", "é" * 100_000]
    df = frame(spark, texts)
    found = {r.doc_id for r in garbled_documents(df).collect()}
    restored = {r.doc_id: r.restored for r in restored_documents(df).collect()}
    return texts, found, restored


def test_exactly_the_garbled_are_found(results):
    _, found, restored = results
    first = len(corpus())
    assert found == set(range(first, first + len(GARBLED)))
    assert set(restored) == found


@pytest.mark.parametrize("nth", range(len(GARBLED)))
def test_the_original_comes_back(results, nth):
    if GARBLED[nth][1] is not None:
        assert results[2][len(corpus()) + nth] == GARBLED[nth][1]


def test_pieces():
    assert ("Ã©", "é") in undo_utf8("Ã©")
    assert ("ÃƒÂ©", "é") in undo_utf8("ÃƒÂ©")
    assert undo_utf8("é") == [] and undo_utf8("ÇÃ") == []


def test_repeated_and_null_ids(spark):
    rows = [(1, "StraÃŸe"), (1, "StraÃŸe"), (None, "fÃ¼r"), (2, "Straße für")] + [(k, "Straße für") for k in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id is None, r.doc_id) for r in garbled_documents(df).collect()) == [(False, 1), (True, None)]


def test_empty_table(spark):
    assert garbled_documents(frame(spark, [])).collect() == [] == restored_documents(frame(spark, [])).collect()


def test_copies_do_not_outnumber_originals(spark):
    clean = [f"{CLEAN[3]} Straße {k} так ÓŁ" for k in range(9)]
    word, piece, sign = CLEAN[3].encode("cp1250").decode("latin-1"), "Die Straße".encode().decode("cp1252"), "schön für ñandú".encode().decode("cp1252")
    texts = clean + [word] * 40 + [piece] * 40 + [f"{sign} {k}" for k in range(40)] + ["öüñú ⠪ӣ"]
    df = frame(spark, texts)
    assert {r.doc_id for r in garbled_documents(df).collect()} == set(range(9, 129))
    restored = {r.doc_id: r.restored for r in restored_documents(df).collect()}
    assert restored[9] == CLEAN[3] and restored[49] == "Die Straße" and restored[89] == "schön für ñandú 0"


def test_entities_of_garbled_characters(spark):
    garbled = "Stra&Atilde;&#159;e und Geb&#195;&curren;ude &amp; mehr &nbsp; &bogus;"
    df = frame(spark, [*corpus(), garbled, "Stra&szlig;e &amp; &eacute;t&eacute; &nbsp;", "a &lt; b &amp; c"])
    first = len(corpus())
    assert {r.doc_id for r in garbled_documents(df).collect()} == {first}
    assert [r.restored for r in restored_documents(df).collect()] == ["Straße und Gebäude &amp; mehr &nbsp; &bogus;"]


def test_words_that_are_rare(spark):
    """Every distinct clean word is in the table: two rare ones under one chain are proof, in any number of documents."""
    clean = ["памятник границы"] * 2 + ["памятник границы здесь", "другой памятник границы"]
    df = frame(spark, [*clean, "памятник границы".encode("koi8-r").decode("cp1251"), "ПАМЯТНИК"])
    assert {r.doc_id for r in garbled_documents(df).collect()} == {4}


def test_map_of_tokens(spark):
    words = ["é", "Straße", "☃" * 50, *map(str, range(500))]
    df = spark.createDataFrame([(w,) for w in words], "token string").select(F.xxhash64("token").alias("h"))
    held = Seen.of(df, len(words))
    assert all(held.may_have(w) for w in words)
    hashes = np.array([hash_of(w) for w in words], np.uint64).astype(np.int64)
    assert held.may_have_all(hashes).all() and set(hashes.tolist()) == {r.h for r in df.collect()}
    few = Seen.of(df, len(words), most_bits=15)
    assert few.may_have_all(hashes).all() and len(few.map) == 4096
    assert sum(held.may_have(f"x{k}") for k in range(2000)) < 200
    assert not Seen.of(df.limit(0), 0).may_have("é")


def test_documents_without_an_id_are_told_apart(spark):
    df = spark.createDataFrame([(None, "fÃ¼r"), (None, "fÃ¼r"), (None, "grÃ¼n"), (None, "für grün")] + [(k, "für grün") for k in range(9)], "doc_id bigint, text string")
    assert [r.doc_id for r in garbled_documents(df).collect()] == [None, None]


def test_lists_of_forms_equal_those_of_single_words():
    words = ["é", "Straße", "памятник", "線路の名前", "“Tolket”…", "naïve", "1\xa0000", "👩‍🌾", "œuvre", "ŻÓŁĆ", "é\x85é", "plain"]
    got = {(words[i], form, chain) for chain, numbers, forms in garbled_lists(words) for i, form in zip(numbers, forms, strict=True)}
    assert got == {(w, form, chain) for w in words for form, chain in garbled_words(w)}
