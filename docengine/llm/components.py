"""Distributed connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every node ends on the smallest node it reaches. Steps are groupBy-min plus a join, so a hub is pre-aggregated before the
shuffle and no neighbourhood is ever gathered; each round is written to the shared folder, so a lost executor costs one
round at most. Rounds are logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: every neighbour above u goes to the least neighbour. Small: u and all below it do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        joined = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = least.select(F.col("u").alias("w"), "m")
        pairs = both.join(least, F.col("u") == F.col("w"))
        joined = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return joined.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), any direction, any repeats -> (node, component), one row for each node of an edge between two nodes."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = written(now)
    state = None
    for _ in range(most_rounds):
        after = written(_star(_star(now, large=True), large=False))
        drop_written(now)
        now = after
        # the edge set as a number; equal twice: nothing moves any more and every node hangs on its root
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Union-find over the links of one chunk: what it gives back has fewer edges than nodes."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]
