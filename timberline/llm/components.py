"""Connected components of an edge table, by alternating large-star and small-star steps.

DataFrame functions only. Every node of the result hangs on the smallest node it can reach. A step takes the least
neighbour of each node (combined before the shuffle) and joins it back, a join that adaptive execution may
split where a node has very many edges. Each round is written to the shared folder; the round before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import remove_copy
from timberline.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours on the far side of each node move to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.filter("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, left: str = "u", right: str = "v", most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge, where ``component`` is the smallest node reachable.

    Edges with a null end and loops are ignored. Repeated edges change nothing. No edges: no rows.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        before, now = now, stored(_star(_star(now, True), False), "edges")
        remove_copy(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )
