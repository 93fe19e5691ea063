"""Connected components of an edge table, by least labels with shortcuts; edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import release, saved

#: Hubs are the nodes that most rows look up, so many at most, those of this many rows or more; their labels are broadcast.
HUBS, HUB_ROWS = 4096, 1000


def _hubs(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HUB_ROWS)
    return saved(counts.orderBy(F.desc("n"), key).limit(HUBS).select(key, F.lit(True).alias("hub")))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, hubs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each ``key`` once. A hub's rows stay where they are and meet the
    few rows of hubs, which are broadcast (HUBS at most); all other rows are dealt by key."""
    marked = rows.join(F.broadcast(hubs), key, "left")
    few = F.broadcast(table.join(F.broadcast(hubs.drop("hub")), key))
    return marked.where("hub").drop("hub").join(few, key).unionByName(marked.where("hub IS NULL").drop("hub").join(table, key))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node of ``edges`` (a, b).

    Each round takes the least label among a node's neighbours, then the label of that label; rounds go on until no
    label falls. Labels are written each round, so the lineage stays short and a lost executor costs one read. A node
    with many neighbours, and the label that a large component shares, are hubs: no task gets all their rows.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    busy = _hubs(both, "b")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    held = labels
    while True:
        seen = _looked_up(both, labels.withColumnRenamed("node", "b"), "b", busy).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = saved(labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("next")))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        shared = _hubs(lower, "next")
        far = _looked_up(lower, jump, "next", shared)
        moved = saved(far.select("node", F.col("far").alias("component"), (F.col("far") < F.col("component")).alias("fell")))
        release(lower, shared, held)
        labels, held = moved.select("node", "component"), moved
        if moved.where("fell").limit(1).isEmpty():
            release(both, busy)
            return labels
