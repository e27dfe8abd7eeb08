"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import materialize


def connected_components(edges: DataFrame, a: str, b: str, limit: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternates large-star and small-star steps, which need O(log^2) rounds. Every step is a map-side
    combined minimum per node and a join whose other side has one row per node, so a hub with very many
    edges is split by the adaptive skew join and never gathered in one task. Each round is written to the
    shared folder. Null ids are dropped; encode them first.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(limit):
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
        if not now[0]:
            break
        both = cur.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(cur.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("mn")).select("n", F.least("n", "mn").alias("mn"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("mn").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("mn"))
        pairs = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("mn").alias("v")), F.struct(F.col("v").alias("u"), F.col("mn").alias("v")))).alias("e"))
        cur = materialize(pairs.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    ends = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = cur.select(F.col("v").alias("u")).distinct().join(ends, "u", "left_anti").select("u", F.col("u").alias("component"))
    return ends.unionAll(roots).withColumnRenamed("u", "node")
