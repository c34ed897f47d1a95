"""Following links of any depth to the end, in rounds whose reach doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.lineage import cut, forget


class Links:
    """Links (id, ref), read by each round of a search that goes on until nothing changes.

    ``widen`` adds links for pairs of links in a row, so a round reaches twice as far. Where that would make more than
    ``most`` times as many links (and more than ``free``), which is counted before it is done, the links stay as they
    are: rounds then reach as far as the last one, so there are more of them, but the result is the same.
    """

    def __init__(self, links: DataFrame, *, most: int = 16, free: int = 1_000_000):
        self.links = cut(links.select("id", "ref").where("id <> ref").distinct(), "links")
        self.limit = max(free, most * self.links.count())
        self.growing = True

    def widen(self) -> None:
        if not self.growing:
            return
        into = self.links.groupBy(F.col("ref").alias("via")).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("a"))
        out = self.links.groupBy(F.col("id").alias("via")).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("b"))
        pairs = into.join(out, "via").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        if pairs == 0 or pairs > self.limit:
            self.growing = False
            return
        further = self.links.select("id", F.col("ref").alias("via")).join(self.links.select(F.col("id").alias("via"), "ref"), "via").select("id", "ref")
        before, self.links = self.links, cut(self.links.unionByName(further.where("id <> ref")).distinct(), "links")
        forget(before)
