"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.shared import stored


#: Parts into which the rows that point at one node are dealt.
PARTS = 8


def by_pointer(rows: DataFrame, table: DataFrame, pointer: str, own: str, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each value of the column pointer.

    Many rows may point at one node, so they are dealt over PARTS tasks by their column own, and each finds a copy of the
    node's row there.
    """
    parts = F.explode(F.array(*map(F.lit, range(PARTS))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(own), F.lit(PARTS)).cast("int"))
    return dealt.join(table.withColumn("_part", parts), [pointer, "_part"], how).drop("_part")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root for every end of edges (a, b: long). A root is a node of the component; which one is not promised.

    Each round points every node at its smallest neighbour, or itself if that is smaller, follows two pointers, and draws
    the edges anew between the nodes pointed at. All nodes that are not the smallest of their neighbourhood vanish, so the
    nodes at least halve. Rounds are cut by tables in the shared folder (a checkpoint
    would keep the estimated sizes of its plan, which multiply by rounds); minima are taken before a shuffle. Repeated edges
    and edges of a node to itself do no harm; a null end joins nothing; no edges give no rows.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    places = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = stored(by_pointer(step, hop, "to", "node").select("node", F.col("next").alias("to")), "step")
        if places is None:
            places = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            places = by_pointer(places, moved, "root", "node", "left").select("node", F.coalesce("to", "root").alias("root"))
        places = stored(places, "places")
        a, b = (step.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        edges = stored(by_pointer(by_pointer(edges, a, "a", "b"), b, "b", "a").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "edges")
    return places if places is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
