"""Connected components of a graph of any size, by alternating rounds that hang neighbours onto the smallest one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import written


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(
        F.col("v1").alias("u1"), F.col("v2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2")
    )
    return edges.unionByName(back)


def _above(a: str, b: str):
    """Whether key ``a`` is above key ``b``."""
    return (F.col(f"{a}1") > F.col(f"{b}1")) | ((F.col(f"{a}1") == F.col(f"{b}1")) & (F.col(f"{a}2") > F.col(f"{b}2")))


def _hung(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hangs its larger (or else its smaller) neighbours onto the smallest node it knows."""
    around = _both_ways(edges) if large else edges
    # edges have u above v, so the neighbours of u in ``edges`` are smaller.
    least = around.groupBy("u1", "u2").agg(F.min_by("v2", "v1").alias("m2"), F.min("v1").alias("m1"))
    m = around.join(least, ["u1", "u2"])
    if large:
        u_is_less = (F.col("u1") < F.col("m1")) | ((F.col("u1") == F.col("m1")) & (F.col("u2") < F.col("m2")))
        m = m.withColumns({"m1": F.when(u_is_less, F.col("u1")).otherwise(F.col("m1")), "m2": F.when(u_is_less, F.col("u2")).otherwise(F.col("m2"))})
        hung = m.where(_above("v", "u")).select(F.col("v1").alias("u1"), F.col("v2").alias("u2"), F.col("m1").alias("v1"), F.col("m2").alias("v2"))
    else:
        moved = m.select(F.col("v1").alias("u1"), F.col("v2").alias("u2"), F.col("m1").alias("v1"), F.col("m2").alias("v2"))
        own = least.select("u1", "u2", F.col("m1").alias("v1"), F.col("m2").alias("v2"))
        hung = moved.unionByName(own)
    return hung.where(_above("u", "v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none: rounds change such edges no more."""
    u, v = (F.struct(F.col(f"{x}1").alias("k1"), F.col(f"{x}2").alias("k2"), F.lit(n).alias("up")) for x, n in (("u", 1), ("v", 0)))
    ends = edges.select(F.inline(F.array(u, v))).groupBy("k1", "k2").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return ends.where("up > 1 or up > 0 and n > up").isEmpty()


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(u1, u2, v1, v2): every linked node, keyed by two longs, and the smallest node of its component.

    ``links`` has the columns u1, u2, v1, v2. The smallest nodes have a row for themselves. Each round is written, so
    that the plan stays short and a lost executor costs one round.
    """
    spark = links.sparkSession
    swapped = _both_ways(links).where(_above("u", "v")).distinct()
    edges = written(spark, swapped, "components")
    for _ in range(most_rounds):
        edges = written(spark, _hung(_hung(edges, True), False), "components")
        if _settled(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    smallest = edges.select(F.col("v1").alias("u1"), F.col("v2").alias("u2"), "v1", "v2").distinct()
    return edges.unionByName(smallest)
