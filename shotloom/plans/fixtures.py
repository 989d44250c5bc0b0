"""Inputs derived from the general tables, deterministically: observations, frames, videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT, ASPECT, DAYS = 1680, 960, 2.17, 30
#: 2024-01-01 as seconds since the epoch.
FIRST_DAY = 1704067200
LANES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for the first event of each user, day and type: lanes of boxes that jitter to the right and down.

    The first event comes from a pre-aggregated minimum, not from a window.
    """
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    lane = F.array_position(F.array(*map(F.lit, LANES)), F.col("event_type")) - 1
    day = F.floor((micros - FIRST_DAY * 1_000_000) / 86_400_000_000).cast("int")
    first = e.select(F.col("user_id").alias("shot_id"), day.alias("frame_idx"), lane.cast("int").alias("lane"), F.struct(micros.alias("t"), "event_id", "value").alias("e"))
    first = first.groupBy("shot_id", "frame_idx", "lane").agg(F.min("e").alias("e"))
    j = F.pmod(F.floor("e.value"), F.lit(60)).cast("int")
    x = F.col("lane") * 300 + j
    return first.select("shot_id", "frame_idx", F.col("e.event_id").alias("obs_ord"), x.alias("x1"), (j + 100).alias("y1"), (x + 120).alias("x2"), (j + 220).alias("y2"))


OBSERVATIONS = f"""
obs AS (
  SELECT shot_id, frame_idx, obs_ord, x AS x1, 100 + j AS y1, x + 120 AS x2, 220 + j AS y2
  FROM (
    SELECT *, CAST(300 * lane + j AS INTEGER) AS x FROM (
      SELECT user_id AS shot_id, frame_idx, lane, event_id AS obs_ord, CAST(CAST(floor(value) AS BIGINT) % 60 AS INTEGER) AS j,
             row_number() OVER (PARTITION BY user_id, frame_idx, lane ORDER BY ts, event_id) AS rn
      FROM (
        SELECT *, CAST(floor((epoch_us(ts) - {FIRST_DAY}000000) / 86400000000) AS INTEGER) AS frame_idx,
               CASE event_type {' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LANES))} END AS lane
        FROM events)
    ) WHERE rn = 1)
)"""


def all_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shot_id, frame_idx): thirty frames for each user."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("shot_id")).distinct()
    return users.select("shot_id", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("frame_idx"))


FRAMES = f"frames AS (SELECT shot_id, CAST(f AS INTEGER) AS frame_idx FROM (SELECT DISTINCT user_id AS shot_id FROM events), range({DAYS}) t(f))"

#: Tracks of disjoint lanes are islands of consecutive frames whose boxes overlap enough.
TRACKS = OBSERVATIONS + """,
lanes AS (SELECT *, x1 // 300 AS lane FROM obs),
prior AS (
  SELECT *, lag(frame_idx) OVER w AS pf, lag(x1) OVER w AS px, lag(y1) OVER w AS py FROM lanes
  WINDOW w AS (PARTITION BY shot_id, lane ORDER BY frame_idx)
),
shared AS (
  SELECT *, greatest(0, 120 - abs(x1 - px)) * greatest(0, 120 - abs(y1 - py)) AS inter FROM prior
),
cut AS (
  SELECT *, CASE WHEN pf = frame_idx - 1 AND CAST(inter AS DOUBLE) / (28800 - inter) >= 0.5 THEN 0 ELSE 1 END AS born FROM shared
),
islands AS (SELECT *, sum(born) OVER (PARTITION BY shot_id, lane ORDER BY frame_idx) AS island FROM cut),
births AS (
  SELECT shot_id, lane, island, min(frame_idx) AS f, arg_min(obs_ord, frame_idx) AS o FROM islands GROUP BY ALL
),
ids AS (SELECT shot_id, lane, island, CAST(row_number() OVER (PARTITION BY shot_id ORDER BY f, o) - 1 AS INTEGER) AS track_id FROM births),
tracked AS (SELECT i.*, ids.track_id FROM islands i JOIN ids USING (shot_id, lane, island))"""
