"""Connected components by alternating large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Edges of one partition; so few of them are joined without shuffles.
PER_PARTITION = 200_000


def _written(edges: DataFrame) -> DataFrame:
    """The distinct edges, written, in partitions by their number (Spark's own coalescing looks at bytes only)."""
    got = materialise(edges, "edges")
    return got.coalesce(max(1, got.count() // PER_PARTITION)).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u long, v long. Returns node, root: the smallest node of its component, for every node of an edge.

    Each star step is a partial minimum for each node and a join, so a hub's edges are never gathered. Loops and
    repeated edges are allowed; no edges give no rows. Raises RuntimeError when it does not settle in max_rounds.
    """
    first = materialise(edges.select("u", "v"), "edges")
    ends = F.explode(F.array("u", "v")).alias("node")
    now = _written(first.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    seen = None
    for _ in range(max_rounds):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = _written(small.where("u <> v"))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
            return first.select(ends).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        seen = mark
    raise RuntimeError("connected components did not settle")
