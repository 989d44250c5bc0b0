"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Shares are fixed by weight, stop at a multiple of a source's size, and the rest
is dealt again by weight. Each source has a weight schedule over training time
0 to 1, piecewise linear; its integral is the source's cumulative demand, whose
inverse gives the time at which each of its words is trained on. Documents are
sorted by range of that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by the sources' order, the cap as a multiple of the source's size, and each weight's schedule: (time, relative weight).
WEIGHTS, CAP = (5, 2, 1), 3
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Hex digits of the order key that make a bucket: running sums are taken in a bucket, and over bucket totals.
DIGITS = 3


def training_time(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a source that follows the schedule has used this share (0 to 1) of its words.

    In a segment from (t0, w0) with slope a the demand grows by w0*x + a*x*x/2, so
    x is 2*d / (w0 + sqrt(w0*w0 + 2*a*d)) for a demand d beyond the segment's start.
    """
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area.append(area[-1] + (w0 + w1) / 2 * (t1 - t0))
    out = None
    for i, ((t0, w0), (t1, w1)) in reversed(list(enumerate(zip(schedule, schedule[1:])))):
        d = F.greatest(F.lit(0.0), share * area[-1] - area[i])
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * d))
        x = F.when(F.lit(w0) + root > 0, F.lit(2.0) * d / (F.lit(w0) + root)).otherwise(F.lit(0.0))
        here = F.least(F.lit(t1), F.lit(t0) + x)
        out = here if out is None else F.when(share * area[-1] <= area[i + 1], here).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (key, source, source_size), one row for each source -> with place, weight and target.

    With the sources in order of cap / weight, the first source whose cap isn't
    reached at the level that those before it leave sets the level for all.
    """
    place = Window.orderBy("key")
    ranked = sizes.withColumn("place", F.row_number().over(place) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    most = F.col("source_size").cast("double") * float(cap)
    line = Window.orderBy("ratio", "place")
    filled = ranked.withColumn("most", most).withColumn("ratio", F.col("most") / F.col("weight")).withColumn(
        "used", F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ).withColumn("open", F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    filled = filled.withColumn("total", F.sum(F.col("source_size").cast("double")).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    filled = filled.withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("set", first).select(
        "key", "source", "source_size", "place", F.least("most", F.coalesce(F.col("set.level"), F.col("level")) * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, schedules=SCHEDULES, carry: list[str] = ()) -> DataFrame:
    """One row for each row of docs: (carried columns, doc_id, source, size, source_size, target, passes, part, taken, position, step).

    size counts the words of the whole text. Words are taken in passes over the
    source, documents in order of the md5 of their id: `passes` whole ones, then
    `part` words from the start of the document in the last, unfinished pass;
    taken = size * passes + part. A source's taken words add up to its target,
    rounded. position is the training time of the document's first word, null if
    nothing is taken; step is the time between its passes.

    Null texts have size 0; a null source is a source of its own, the last; null
    ids come first in their source's order; rows with equal ids are ordered by
    size, and equal rows are interchangeable. Texts of any length are counted
    whole. Without words all targets are 0. An empty table gives an empty result.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(
        *[F.col(c).alias(a) for c, a in zip(carry, names)],
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )
    rows = rows.withColumn("key", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))).withColumn("order", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")))
    rows = stored(rows.withColumn("bucket", F.substring("order", 1, DIGITS)), "mix")
    totals = rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).select("key", "bucket", "offset")
    sizes = totals.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    offsets = offsets.join(source_targets(sizes, weights, cap).drop("source"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("order", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["key", "bucket"])
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    placed = placed.withColumn("start", F.col("start") + F.col("offset")).withColumn("wanted", wanted)
    placed = placed.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.expr("wanted div source_size"))).otherwise(0).cast("long"))
    rest = F.col("wanted") - F.col("passes") * F.col("source_size") - F.col("start")
    placed = placed.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", rest)))
    placed = placed.withColumn("taken", F.col("size") * F.col("passes") + F.col("part"))
    time = None
    for i, s in enumerate(schedules):
        t = training_time(F.col("start").cast("double") / F.col("wanted").cast("double"), s)
        time = t if time is None else F.when(F.col("place") % len(schedules) == i, t).otherwise(time)
    return placed.select(
        *[F.col(a).alias(c) for c, a in zip(carry, names)], "doc_id", "source", "size", "source_size", "target", "passes", "part", "taken",
        F.when(F.col("taken") > 0, time).alias("position"), "start", "wanted", "place",
    )


def curriculum(plan: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """mix()'s rows as the order of training: one row for each time a document is taken, sorted by range of its position.

    Adds pass (from 0), words (all of the document but for an unfinished pass) and position.
    """
    times = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = plan.where("taken > 0").drop("position").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    used = (F.col("start") + F.col("pass") * F.col("source_size")).cast("double") / F.col("wanted").cast("double")
    time = None
    for i, s in enumerate(schedules):
        t = training_time(used, s)
        time = t if time is None else F.when(F.col("place") % len(schedules) == i, t).otherwise(time)
    rows = rows.withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("size")).otherwise(F.col("part"))).withColumn("position", time)
    return rows.orderBy("position", "source", "start", "pass")
