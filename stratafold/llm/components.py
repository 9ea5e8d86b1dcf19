"""Connected components of a distributed edge table by alternating large and small stars.

Edges stay in tables throughout: every step is an aggregate with map-side minima and a
join back on the same key, so nodes with very many edges are split by adaptive joins.
Each round is written to the shared folder, which cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.scratch import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """edges(a, b): undirected -> (node, component), component being the least node.

    Nodes without an edge to another node are left out.  Null ends are ignored.
    """
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialize(edges.where("a != b").select(big, small).distinct(), tag)
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = materialize(large, tag)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), tag)
        after = _state(now)
        if after == before:
            break
        before = after
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
