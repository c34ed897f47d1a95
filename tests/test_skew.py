from collections import Counter

from tilewright.operators.skew import heavy_keys, keys_above_share, salted_totals

SCHEMA = "qt bigint, weight bigint, k string, salt int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def test_totals_with_hot_null_and_copied_keys(spark):
    rows = [(7, 1)] * 500 + [(None, 2)] * 300 + [(k, k) for k in range(100)] + [(200, None), (201, None), (201, 5)]
    df = frame(spark, rows)
    want = {k: (n, (lambda v: sum(v) if v else None)([w for q, w in rows if q == k and w is not None])) for k, n in Counter(q for q, _ in rows).items()}
    for heavy in (None, [], [7, 200]):
        got = {r.qt: (r.n, None if r.total is None else int(r.total)) for r in salted_totals(df, "qt", "weight", heavy=heavy).collect()}
        assert got == want
    assert 7 in heavy_keys(df, "qt")


def test_share_counts_all_rows_and_ties(spark):
    rows = [(1, 1)] * 2 + [(None, 1)] * 49 + [(2, 1)] + [(k, 1) for k in range(100, 148)]
    assert {r.qt for r in keys_above_share(frame(spark, rows), "qt", "weight", 2).collect()} == {1, None}


def test_sums_beyond_64_bits(spark):
    got = salted_totals(frame(spark, [(1, 2**62)] * 4), "qt", "weight").first()
    assert int(got.total) == 2**64


def test_empty_table(spark):
    assert salted_totals(frame(spark, []), "qt", "weight").collect() == []
    assert keys_above_share(frame(spark, []), "qt", "weight", 2).collect() == []
