import random

import pytest

from tilewright.operators.history import attribute_history, version_history

SCHEMA = "type int, id bigint, version bigint, time bigint, visible boolean, _chunk string, _hash int"


def history(spark, rows, **more):
    out = version_history(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), ["type", "id"], **more)
    return {(r.type, r.id, r.version): (r.valid_from, r.valid_to, r.visible) for r in out.collect()}


def plain(rows):
    seen = {}
    for type_, id_, version, time, visible in rows:
        if None in (type_, id_, version, time):
            continue
        old = seen.setdefault((type_, id_), {}).get(version, (time, False))
        seen[type_, id_][version] = (min(old[0], time), old[1] or bool(visible))
    return {(*e, v): (t, states[min(w for w in states if w > v)][0] if any(w > v for w in states) else -1, vis) for e, states in seen.items() for v, (t, vis) in states.items()}


@pytest.mark.parametrize("chunk", [65_536, 4])
def test_equals_plain_loop(spark, chunk):
    rng = random.Random(1)
    rows = [(rng.choice([0, 1, None]), rng.choice([1, 2, 3, None]), rng.choice([*range(12), 40, None]), rng.choice([*range(100), None]), rng.choice([True, False, None])) for _ in range(400)]
    assert history(spark, rows, chunk=chunk) == plain(rows)


def test_late_and_copied_rows(spark):
    rows = [(0, 1, 2, 50, True), (0, 1, 1, 10, True), (0, 1, 1, 12, True), (0, 1, 1, 10, True), (0, 1, 3, 90, False)]
    assert history(spark, rows) == {(0, 1, 1): (10, 50, True), (0, 1, 2): (50, 90, True), (0, 1, 3): (90, -1, False)}


def test_empty_table(spark):
    assert history(spark, []) == {}


ATTRIBUTES = "type int, id bigint, snap int, day bigint, version bigint, changeset bigint, _island int"


def runs(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], ATTRIBUTES)
    return sorted(((r.type, r.id, r.version, r.changeset, r.valid_from, r.valid_to, r.snapshots) for r in attribute_history(df, ["type", "id"], "snap", "day", ["version", "changeset"], **more).collect()), key=str)


def plain_runs(rows):
    key = lambda v: (v is not None, v or 0)
    states = {}
    for t, i, s, day, v, c in rows:
        if None in (t, i, s, day):
            continue
        old = states.setdefault((t, i), {}).get(s)
        best = max([(v, c)] + ([old[0]] if old else []), key=lambda a: (key(a[0]), key(a[1])))
        states[t, i][s] = (best, min([day] + ([old[1]] if old else [])))
    out = []
    for e, by in states.items():
        made = []
        for s in sorted(by):
            (v, c), day = by[s]
            if made and made[-1][:2] == [v, c]:
                made[-1][2], made[-1][3] = min(made[-1][2], day), made[-1][3] + 1
            else:
                made.append([v, c, day, 1])
        out += [(*e, v, c, day, made[k + 1][2] if k + 1 < len(made) else -1, n) for k, (v, c, day, n) in enumerate(made)]
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [65_536, 3])
def test_attributes_that_return_and_restate(spark, chunk):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, None]), rng.choice([1, 2, None]), rng.choice([*range(20), 33, None]), rng.choice([*range(90), None]), rng.choice([1, 1, 2, None]), rng.choice([7, 7, 8, None])) for _ in range(300)]
    assert sorted(runs(spark, rows, chunk=chunk), key=str) == plain_runs(rows)


def test_equal_neighbours_are_one_run_and_a_return_is_another(spark):
    rows = [(0, 1, s, 10 * s, v, c) for s, (v, c) in enumerate([(1, 5), (1, 5), (2, 6), (2, 6), (1, 5), (1, 9)])]
    assert runs(spark, rows) == [(0, 1, 1, 5, 0, 20, 2), (0, 1, 1, 5, 40, 50, 1), (0, 1, 1, 9, 50, -1, 1), (0, 1, 2, 6, 20, 40, 2)]
    assert runs(spark, []) == []
