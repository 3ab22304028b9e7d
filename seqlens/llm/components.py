"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

#: Edges a task holds at least: few edges are not spread over many tasks.
EDGES_A_TASK = 20_000


class _Steps:
    """The two steps, in tasks that fit the number of edges."""

    def __init__(self, edges: int):
        self.tasks = edges // EDGES_A_TASK + 1

    def fit(self, df: DataFrame) -> DataFrame:
        return df.coalesce(self.tasks)

    def down(self, edges: DataFrame, u, v) -> DataFrame:
        """Distinct edges with the larger end in u; loops go."""
        named = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        return self.fit(self.fit(named.filter("u <> v")).distinct())

    def large_star(self, edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = self.fit(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        return self.down(both.join(least, "u").filter("v > u"), F.col("v"), F.col("m"))

    def small_star(self, edges: DataFrame) -> DataFrame:
        least = self.fit(edges.groupBy("u").agg(F.min("v").alias("m")))
        return self.down(edges.join(least, "u").select("v", "m").union(least.select("u", "m")), F.col("v"), F.col("m"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of all nodes with an edge to another; root is the smallest node of the component.

    Every round is written to the shared folder; only one count and one checksum a round reach the driver."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        steps = _Steps(state[0])
        last, now = now, stored(steps.small_star(steps.large_star(now)), "edges")
        drop(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def join_components(roots: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """Components after further links: only the roots that the links touch are worked on."""
    if links.isEmpty():
        return roots
    of = {x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in (a, b)}
    between = links.select(a, b).join(of[a], a, "left").join(of[b], b, "left")
    between = between.select(F.coalesce(f"{a}_root", a).alias("x"), F.coalesce(f"{b}_root", b).alias("y"))
    above = connected_components(between, "x", "y").withColumnRenamed("node", "old").withColumnRenamed("root", "new")
    moved = roots.withColumnRenamed("root", "old").join(above, "old", "left").select("node", F.coalesce("new", "old").alias("root"))
    single = above.select(F.col("old").alias("node"), F.col("new").alias("root")).join(roots.select("node"), "node", "left_anti")
    return moved.union(single)
