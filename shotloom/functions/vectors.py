"""Vector expressions over array columns, and means of vectors by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    whole = norm(a) * norm(b)
    return F.when(whole > 0, dot(a, b) / whole)


def similar(a: Column, b: Column, threshold: float, single: bool = False) -> Column:
    """cosine >= threshold; `single` compares as single precision."""
    c = cosine(a, b)
    return c.cast("float") >= F.lit(threshold).cast("float") if single else c >= threshold


def usable(a: Column, length: int | None = None) -> Column:
    """Not null, of the length, all components finite."""
    fine = a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine if length is None else fine & (F.size(a) == length)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "mean") -> DataFrame:
    """The component-wise mean by group; rows with a null vector don't count, a group of them alone has a null mean.

    Components are averaged with partial aggregation before the shuffle; only
    one row for each group and component moves.
    """
    parts = df.select(*keys, F.posexplode_outer(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    listed = F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_m"))))
    whole = parts.groupBy(*keys).agg(listed.alias("_v"))
    return whole.select(*keys, F.when(F.size("_v") > 0, F.transform("_v", lambda s: s["_m"])).alias(out))
