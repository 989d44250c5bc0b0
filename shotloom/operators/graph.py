"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.scratch import discard, stored

#: Edges in a file of a round, once their number is known.
FILE = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): root is the smallest node of the component.

    Only nodes on some edge appear. Loops, repeats and either direction are
    allowed; null ends are ignored; no edges give no rows. Each node keeps its
    smallest neighbour only, so a hub is a pre-aggregated minimum. The minima are
    dealt anew before they are joined back: the join then has exchanges of its
    own, and adaptive execution can split a hub's edges.
    """
    def written(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
        """df stored, and its count and hash sum, taken while it is written; rounds never add edges, so few are written in few files."""
        told = Observation()
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE)))
        kept = stored(df.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")).alias("mark")), "edges")
        return kept, (told.get["n"], told.get["mark"])

    now, seen = written(edges.where("u <> v").select(F.greatest("u", "v").alias("child"), F.least("u", "v").alias("parent")).distinct())
    mark = None
    while seen[0] and seen != mark:
        mark = seen
        both = now.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(now.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("rebalance")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        low = large.groupBy("child").agg(F.min("parent").alias("m")).hint("rebalance")
        ends = F.array(*[F.struct(F.col(c).alias("child"), F.col("m").alias("parent")) for c in ("child", "parent")])
        small = large.join(low, "child").select(F.explode(ends).alias("e")).select("e.*").where("child <> parent").distinct()
        before = now
        now, seen = written(small, mark[0])
        discard(before)
    roots = now.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    return now.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(roots)
