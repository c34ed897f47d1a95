import random

from tilewright.operators.references import key_runs, orphan_references

REFS = "src_type int, src_id bigint, ref_type int, ref_id bigint, chunk int, probe string"
KEYS = "kind int, id bigint, start string"


def orphans(spark, refs, live, known, late):
    keys = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], KEYS)
    out = orphan_references(spark.createDataFrame([(*r, 0, None) for r in refs], REFS), keys(live), keys(known), keys(late))
    return sorted(tuple(r) for r in out.collect())


def test_equals_sets(spark):
    rng = random.Random(5)
    key = lambda: (rng.choice([0, 1]), rng.choice([rng.randrange(-300, 300), rng.randrange(65_400, 65_700), 2**40]))
    live, known, late = ([key() for _ in range(n)] for n in (500, 100, 60))
    refs = [(rng.choice([1, 2]), rng.randrange(9), *key()) for _ in range(900)]
    refs += refs[:50] + [(1, 1, None, 3), (1, 1, 0, None), (None, 1, 0, 5)]
    want = sorted((*r, "late" if r[2:] in late else "deleted" if r[2:] in known else "missing") for r in set(refs) if None not in r and r[2:] not in set(live))
    assert orphans(spark, refs, live + [(None, 1), (0, None)], known, late) == want


def test_runs_end_at_range_borders(spark):
    rows = key_runs(spark.createDataFrame([(0, n) for n in [1, 2, 3, 3, 5, 65_535, 65_536, -1, 0]], "kind int, id bigint")).collect()
    assert sorted((r.start, r.end) for r in rows) == [(-1, -1), (0, 3), (5, 5), (65_535, 65_535), (65_536, 65_536)]


def test_empty_tables(spark):
    assert orphans(spark, [], [], [], []) == []
    assert orphans(spark, [(1, 2, 0, 3)], [], [], []) == [(1, 2, 0, 3, "missing")]
