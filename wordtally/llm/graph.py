"""Connected components of a distributed edge list, without collecting links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtally.llm.common import Work


def spanning_forest(a, b):
    """Edges of a spanning forest of the links ``a[i] - b[i]`` (index arrays), found with a union-find in one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a, b)):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(i)
    return keep


def components(edges: DataFrame, work: Work, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected ``edges`` (a, b).

    Alternating large-star and small-star steps: every node hands its
    neighbours to the least of them. Each step is a grouped minimum (map-side
    combined) and an equi-join, so a node with very many neighbours is never
    gathered in one task; each round is written out, which cuts lineage.
    """
    cur = work.store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0")
    step = 0

    def digest(df: DataFrame):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = digest(cur)
    while before[0]:
        # large star: each neighbour above a node is linked to the least of the node and its neighbours
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = work.store(large, f"{name}_{step}l")
        # small star: each lower neighbour, and the node itself, is linked to the least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        nxt = work.store(nxt, f"{name}_{step + 1}")
        after = digest(nxt)
        work.drop(f"{name}_{step}")
        work.drop(f"{name}_{step}l")
        cur, step = nxt, step + 1
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
