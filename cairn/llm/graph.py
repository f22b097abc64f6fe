"""Distributed connected components by alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cairn.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges run from larger (u) to smaller (v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and their number and a checksum, which are taken while they are."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    return table, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Of an edge table, each node's component: columns node and component, the smallest node that it reaches.

    Nodes are of any type that Spark orders.  Null ends and loops are left out, repeated edges count once.  The edge
    table shrinks towards one edge a node; each round is a written table, so a lost executor costs one round at most.
    Nothing is collected but a count and a checksum.  Raises if max_rounds don't suffice (rounds grow with the
    logarithm of the longest path).
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    (now, mark), before = _marked(now.distinct()), None
    for _ in range(max_rounds):
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, (now, mark) = mark, _marked(_small_star(_large_star(now).distinct()).distinct())
    raise RuntimeError(f"components: not done after {max_rounds} rounds")
