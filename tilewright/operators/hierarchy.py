"""Parent-child links resolved to full hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.lineage import cut, forget, task_count

#: Siblings are numbered in so many buckets a parent for each this many nodes; paths are made in ranges of as many nodes.
RANGE = 50_000


def _subtree_sizes(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Sizes upward by pointer doubling; the pointer tables of all rounds.

    After round k a node's pointer leads 2**k links up, or to its root if that is nearer (``done``), and ``size``
    counts its descendants within fewer than 2**k links, itself included. The number of nodes that have not reached a
    root falls in every round while any node outside a circle is left; once it stays, the rest hangs on circles.
    """
    ids = links.select(F.col("parent").alias("node")).union(links.select("child")).distinct()
    state = ids.join(links.select(F.col("child").alias("node"), "parent"), "node", "left").select(
        "node",
        "parent",
        F.coalesce("parent", "node").alias("ptr"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.col("parent").isNull().alias("done"),
        F.lit(1).cast("bigint").alias("size"),
    )
    rounds, step, left = [], 1, None
    while True:
        state = cut(state, "tree")
        open_now = state.where("not done").count()
        rounds.append(state)
        if open_now == 0 or open_now == left:
            return state, rounds
        left = open_now
        targets = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"))
        jumped = state.where("not done").join(targets, "ptr").select("node", "parent", F.col("ptr2").alias("ptr"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("done2").alias("done"), "size")
        gained = state.where(F.col("hops") == step).groupBy(F.col("ptr").alias("node")).agg(F.sum("size").alias("gain"))
        state = state.where("done").unionByName(jumped).join(gained, "node", "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).drop("gain")
        step *= 2


def _preorder(sizes: DataFrame, rounds: list[DataFrame], nodes: int) -> DataFrame:
    """Start of each node's preorder range: prefix sums of sibling sizes, then sums down from the root by doubling.

    Siblings (roots are siblings too) are divided by a hash into buckets, so that no window group grows with a hot
    parent beyond its share; the buckets' totals are summed in a second, small step.
    """
    buckets = max(1, -(-nodes // RANGE))
    kin = sizes.select("node", "parent", "size", F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket"))
    within = F.sum("size").over(Window.partitionBy("parent", "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    totals = kin.groupBy("parent", "bucket").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    totals = totals.select(F.col("parent").alias("p"), F.col("bucket").alias("b"), before.alias("before"))
    kin = kin.withColumn("within", within)
    start = kin.join(totals, kin["parent"].eqNullSafe(totals["p"]) & (kin["bucket"] == totals["b"])).select("node", (F.col("within") + F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("pre"))
    before = None
    for k, pointers in enumerate(rounds[:-1]):
        start = cut(start, "preorder")
        if before is not None:
            forget(before)
        before = start
        up = pointers.where(F.col("hops") == 2**k).select("node", "ptr").join(start.select(F.col("node").alias("ptr"), F.col("pre").alias("above")), "ptr").select("node", "above")
        start = start.join(up, "node", "left").select("node", (F.col("pre") + F.coalesce("above", F.lit(0))).alias("pre"))
    return start


def hierarchy(links: DataFrame, *, paths: bool = True) -> DataFrame:
    """(id, root_id, depth, pre, size, path) of every node of parent-child links of any depth.

    ``links``: ``parent``, ``child`` bigint. Copied links count once, links with a null end are left out, extra
    columns are ignored. A child with several parents keeps the smallest. ``pre`` and ``size`` are the node's
    nested-set range: its descendants are the nodes with ``pre`` in (pre, pre + size). ``path`` joins the ids from the
    root by ``/``. A node on a circle (a link to itself is one) or below one has root_id -1, depth -1, null ``pre``
    and ``size`` and the path ``cycle``.

    Sizes are summed upward and preorder starts downward in a number of rounds that is the logarithm of the depth;
    nodes that never reach a root reveal circles. Paths come from one sweep over the preorder, in ranges: a node
    whose own range reaches into later ranges is sent there too, so every range starts with its open ancestors.
    """
    spark = links.sparkSession
    links = links.select("parent", "child").dropna().groupBy("child").agg(F.min("parent").alias("parent"))
    state, rounds = _subtree_sizes(links)
    tree, nodes = state.where("done"), state.count()
    sizes = tree.select("node", "parent", "size")
    start = _preorder(sizes, rounds, nodes)
    known = cut(tree.join(start, "node").select(F.col("node").alias("id"), F.col("ptr").alias("root_id"), F.col("hops").alias("depth"), "pre", "size"), "ranges")
    for pointers in rounds[:-1]:
        forget(pointers)
    stuck = state.where("not done").select(F.col("node").alias("id"), F.lit(-1).cast("bigint").alias("root_id"), F.lit(-1).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("pre"), F.lit(None).cast("bigint").alias("size"), F.lit("cycle").alias("path"))
    if not paths:
        return known.withColumn("path", F.lit(None).cast("string")).unionByName(stuck)
    schema = "id bigint, root_id bigint, depth bigint, pre bigint, size bigint, path string"
    names = ["id", "root_id", "depth", "pre", "size", "path"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[int, str]] = []
        now = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            text = 0
            for slot, own, *row in zip(*(batch.column(c).to_pylist() for c in ("slot", "own", *names[:-1]))):
                if slot != now:
                    now, open_ = slot, []
                pre, size = row[3], row[4]
                while open_ and open_[-1][0] <= pre:
                    open_.pop()
                path = f"{open_[-1][1]}/{row[0]}" if open_ else str(row[0])
                if size > 1:
                    open_.append((pre + size, path))
                if own:
                    for column, value in zip(out, [*row, path]):
                        column.append(value)
                    text += len(path)
                if text > 1 << 24:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.string())], names=names)
                    out, text = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.string())], names=names)

    slots = F.sequence(F.floor(F.col("pre") / RANGE), F.floor((F.col("pre") + F.col("size") - 1) / RANGE))
    spread = known.select("*", F.posexplode(slots).alias("nth", "slot")).withColumn("own", F.col("nth") == 0).drop("nth")
    swept = spread.repartition(task_count(spark, nodes, 4 * RANGE), "slot").sortWithinPartitions("slot", "pre").mapInArrow(sweep, schema)
    return swept.unionByName(stuck)
