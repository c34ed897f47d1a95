import random
from collections import Counter

import pytest

from tilewright.llm import frequency
from tilewright.llm.frequency import marked_terms, term_frequencies

SCHEMA = "terms array<struct<key:string,val:string>>, key string, term_id int, records int"


def frame(spark, records):
    return spark.createDataFrame([(r, "x", 1, 2) for r in records], SCHEMA)


@pytest.mark.parametrize("block", [400_000, 3])
def test_equals_counters(spark, monkeypatch, block):
    monkeypatch.setattr(frequency, "BLOCK_TERMS", block)
    rng = random.Random(3)
    term = lambda: (rng.choice(["a", "b", "", None]), rng.choice(["x", "y", "ü" * 50, "", None, *map(str, range(20))]))
    records = [rng.choice([None, [], [term() for _ in range(rng.randrange(1, 6))]]) for _ in range(400)] + [[("hot", "one")] * 3] * 200
    occurrences, present = Counter(), Counter()
    for r in records:
        known = [t for t in r or () if None not in t]
        occurrences.update(known)
        present.update(set(known))
    found, total = term_frequencies(frame(spark, records).repartition(3), "terms")
    rows = found.collect()
    assert total == sum(bool(r) for r in records)
    assert {(r.key, r.val): (r.occurrences, r.records) for r in rows} == {t: (occurrences[t], present[t]) for t in occurrences}
    assert len(rows) == len(occurrences)


def test_marks_and_their_borders(spark):
    records = [[("a", "1")]] * 2 + [[("b", "1")]] * 3 + [[("c", str(k))] for k in range(54)] + [[(None, "z")]]
    rows = {(r.key, r.val): r.mark for r in marked_terms(frame(spark, records), "terms").collect()}
    assert rows["a", "1"] == "rare" and rows["b", "1"] == "common" and rows["c", "5"] == "rare"  # 3 of 60


def test_empty_tables(spark):
    for records in ([], [None], [[]]):
        found, total = term_frequencies(frame(spark, records), "terms")
        assert found.collect() == [] and total == 0


def test_long_value(spark):
    assert [(len(r.val), r.records) for r in marked_terms(frame(spark, [[("k", "v" * 300_000)]]), "terms").collect()] == [(300_000, 1)]
