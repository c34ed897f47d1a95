import itertools
import random

from tilewright.operators.patches import composed_patches, current_table, final_state, patched_table

INFO = "info struct<version:bigint>"
CHANGES = f"id bigint, changetype int, {INFO}, file_idx int, name string, chunk string, patch int"
BASE = f"id bigint, changetype int, {INFO}, name string, ground string"


def frames(spark, changes, base):
    one = spark.createDataFrame([(i, c, None if v == "none" else (v,), f, n, "x", 0) for i, c, v, f, n in changes], CHANGES)
    return one, spark.createDataFrame([(i, c, None if v == "none" else (v,), n, "x") for i, c, v, n in base], BASE)


def state(spark, changes, base):
    return {r.id: (r.version, r.name) for r in final_state(*frames(spark, changes, base), ["name"]).collect()}


def plain(changes, base):
    out, low = {}, -(2**63)
    num = lambda v: low if v in (None, "none") else v
    for i in {c[0] for c in changes if c[0] is not None and c[1] in (1, 4, 5)}:
        acts = [((num(v), 1, low if f is None else f, c, n or ""), c != 1, v, n) for j, c, v, f, n in changes if j == i and c in (1, 4, 5)]
        stood = [((num(v), 0, 0, c not in (1, 2), n or ""), c not in (1, 2), v, n) for j, c, v, n in base if j == i]
        _, there, v, n = max(acts + stood, key=lambda r: r[0])
        if there:
            out[i] = (None if v == "none" else v, n)
    return out


def test_equals_plain_loop(spark):
    rng = random.Random(4)
    changes = [(rng.choice([*range(40), None]), rng.choice([0, 1, 2, 3, 4, 5, None]), rng.choice([1, 2, 3, None, "none"]), rng.choice([1, 2, 30, None]), rng.choice("abc")) for _ in range(300)]
    base = [(rng.choice([*range(50), None]), rng.choice([0, 1, 2, None]), rng.choice([1, 2, 3, 4, None]), rng.choice("xyz")) for _ in range(80)]
    assert state(spark, changes, base) == plain(changes, base)


def test_order_and_repetition_do_not_matter(spark):
    changes = [(1, 5, 1, 1, "a"), (1, 4, 2, 3, "b"), (1, 4, 2, 9, "c"), (1, 1, 1, 20, "d")]
    for some in list(itertools.permutations(changes))[::8]:
        assert state(spark, [*some, some[0]], [(1, 0, 2, "base")]) == {1: (2, "c")}


def test_parts_compose_to_the_whole(spark):
    rng = random.Random(8)
    changes = [(rng.randrange(3), rng.choice([1, 4, 5]), rng.randrange(5), rng.randrange(60), rng.choice("ab")) for _ in range(200)]
    df, _ = frames(spark, changes, [])
    results = [{r.id: r.patch for r in composed_patches(df, ["name"], chunk_files=w).collect()} for w in (1, 8, 1000)]
    assert results[0] == results[1] == results[2]


def test_empty_tables(spark):
    assert state(spark, [], []) == {} == state(spark, [], [(1, 0, 1, "a")])
    assert state(spark, [(1, 4, 1, 1, "a")], []) == {1: (1, "a")}


def test_current_table_keeps_what_no_change_names(spark):
    changes, base = [(1, 4, 2, 1, "new"), (2, 1, 9, 1, "x"), (5, 5, 1, 1, "made"), (None, 4, 1, 1, "n")], [(1, 0, 1, "old"), (2, 0, 1, "gone"), (3, 0, 4, "kept"), (4, 1, 1, "dead"), (None, 0, 1, "n")]
    got = {r.id: (r.version, r.name) for r in current_table(*frames(spark, changes, base), ["name"]).collect()}
    assert got == {1: (2, "new"), 3: (4, "kept"), 5: (1, "made")}


PATCH = f"id bigint, changetype int, {INFO}, file_idx int, a string, b string, c0 int, last int"


def patched(spark, changes, base, **more):
    one = spark.createDataFrame([(i, c, (v,), f, a, b, 0, 0) for i, c, v, f, a, b in changes], PATCH)
    two = spark.createDataFrame([(i, c, (v,), a, b) for i, c, v, a, b in base], f"id bigint, changetype int, {INFO}, a string, b string")
    return {r.id: (r.version, r.a, r.b) for r in patched_table(one, two, ["a", "b"]).collect()}


def plain_patched(changes, base):
    out = {}
    num = lambda v: -1 if v is None else v
    for i in {r[0] for r in changes + base if r[0] is not None}:
        steps = [((num(v), num(f), c), c, v, a, b) for j, c, v, f, a, b in changes if j == i and c in (1, 4, 5)]
        stood = [((num(v), c not in (1, 2), a or "", b or ""), c not in (1, 2), v, a, b) for j, c, v, a, b in base if j == i]
        row, version, there, since = {}, None, False, -2
        if stood:
            _, there, version, a, b = max(stood)
            row, since = ({"a": a, "b": b} if there else {}), num(version)
        for at, c, v, a, b in sorted(steps, key=lambda s: (s[0], s[3] or "", s[4] or "")):
            if at[0] < since:
                continue
            if c != 4:
                if not (row.get("at") == at and c == 5):
                    row = {"at": at}
            if c != 1:
                row |= {k: x for k, x in (("a", a), ("b", b)) if x is not None}
            version, there = v, c != 1
        if there:
            out[i] = (version, row.get("a"), row.get("b"))
    return out


def test_patches_of_columns_equal_a_plain_loop(spark):
    rng = random.Random(6)
    changes = [(rng.choice([*range(30), None]), rng.choice([0, 1, 4, 4, 4, 5]), rng.choice([1, 2, 3, None]), k, rng.choice(["p", "q", None]), rng.choice(["r", None])) for k in range(250)]
    rng.shuffle(changes)
    base = [(k, rng.choice([0, 0, 1]), rng.choice([1, 2]), rng.choice(["x", None]), "y") for k in range(35)]
    assert patched(spark, changes + changes[:40], base) == plain_patched(changes, base)
    assert patched(spark, [], []) == {}
