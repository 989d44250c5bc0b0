"""Intervals expanded to frames, and joins of overlays with frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(shots: DataFrame, key: str, order: str) -> DataFrame:
    """(key, frame_idx, shot_number, marker) for every frame of every shot; of overlapping shots the last holds.

    marker is 1 on a shot's first frame, -1 on its last, else 0.
    """
    rows = shots.select(key, "shot_number", F.col(order).alias("_o"), "first_frame", "last_frame").where("first_frame <= last_frame")
    rows = rows.withColumn("frame_idx", F.explode(F.sequence("first_frame", "last_frame")))
    marker = F.when(F.col("frame_idx") == F.col("first_frame"), 1).when(F.col("frame_idx") == F.col("last_frame"), -1).otherwise(0)
    top = rows.groupBy(key, "frame_idx").agg(F.max_by(F.struct("shot_number", marker.alias("marker")), "_o").alias("_s"))
    return top.select(key, "frame_idx", "_s.shot_number", "_s.marker")


def with_overlays(frames: DataFrame, overlays: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Every frame with its overlays as an ordered array, empty where there is none."""
    listed = overlays.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("overlays"))
    kind = listed.schema["overlays"].dataType.simpleString()
    return frames.join(listed, keys, "left").withColumn("overlays", F.coalesce("overlays", F.array().cast(kind)))


def overlay_range(overlays: DataFrame, key: str) -> DataFrame:
    """First, last and number of frames with overlays, by key."""
    return overlays.groupBy(key).agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.countDistinct("frame_idx").alias("n_frames"))


def beyond_end(overlays: DataFrame, frames: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Frames with overlays that the video doesn't have, in order, the first `limit`."""
    extra = overlays.select(*keys).distinct().join(frames, keys, "left_anti")
    return extra if limit is None else extra.orderBy(*keys).limit(limit)


def tail_probe(frames: DataFrame, overlays: DataFrame, key: str, totals: DataFrame, last: int = 10) -> DataFrame:
    """(key, frame_idx, n) for the last frames of each video: how many overlays they have. totals is (key, n_frames)."""
    near = frames.join(totals, key).where((F.col("frame_idx") >= F.greatest(F.lit(0), F.col("n_frames") - last)) & (F.col("frame_idx") < F.col("n_frames"))).select(key, "frame_idx")
    counts = overlays.groupBy(key, "frame_idx").agg(F.count("*").alias("_n"))
    return near.join(counts, [key, "frame_idx"], "left").select(key, "frame_idx", F.coalesce("_n", F.lit(0)).alias("n"))


def by_position(documents: DataFrame, frames: DataFrame, key: str, rows: str) -> DataFrame:
    """Array entries joined to frames by position: entry i goes with frame i, until the shorter ends."""
    return documents.select(key, F.posexplode(rows).alias("frame_idx", "entry")).join(frames, [key, "frame_idx"])


def zipped(*arrays: str):
    """An array of structs of arrays' entries, as long as the shortest."""
    sizes = [F.size(a) for a in arrays]
    return F.slice(F.arrays_zip(*arrays), F.lit(1), F.least(*sizes) if len(sizes) > 1 else sizes[0])
