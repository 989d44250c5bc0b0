"""Frames: range scans, and a synthetic video as a data source. Pixels stay out of relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def range_scan(frames: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """Frames first to last, both included; none if last < first. On frame_idx, so that it reaches the scan."""
    return frames.where(F.col("frame_idx").between(first, last))


def timed_scan(frames: DataFrame, first: int, last: int, fps: float, tb_num: int, tb_den: int, order: str, preroll: int = 5, keys: tuple[str, ...] = (), stamped: bool = False) -> DataFrame:
    """The frames from `first` on by time stamp, as many as wanted, from a decode that starts a little earlier.

    Where pts is known it must reach the start's; else the time must, within
    1e-9 s; else the preroll's frames are skipped by count. Frames come in `order`.
    With keys, every video that they name is scanned by itself; counting then runs
    in each video's partition. stamped promises a pts or time in every frame, so
    that nothing is counted at all.
    """
    wanted = last - first + 1
    if wanted <= 0:
        return frames.limit(0)
    start = first / fps
    start_pts = round(start * tb_den / tb_num)
    skip = max(0, round((start - max(0.0, start - preroll / fps)) * fps))
    late = F.when(F.col("pts").isNotNull(), F.col("pts") >= start_pts).when(F.col("time_sec").isNotNull(), F.col("time_sec") + 1e-9 >= start)
    if not stamped:
        # the decoder hands out a video's frames in order; only frames without stamps need counting
        blind = F.col("pts").isNull() & F.col("time_sec").isNull()
        line = Window.partitionBy(*keys).orderBy(order)
        late = late.otherwise(F.sum(blind.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > skip)
    reached = frames.withColumn("_reached", late).where("_reached").drop("_reached")
    if not keys:
        return reached.orderBy(order).limit(wanted)
    return reached.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= wanted).drop("_n").sort(*keys, order)


def point_lookup(frames: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The named frames only."""
    return frames.join(wanted.select(*keys).distinct(), keys, "left_semi")


class SyntheticVideo(DataSource):
    """`shotloom_video`: frames of a generated clip. Options: seconds, fps, width, height, pixels (true adds `img`).

    The first half is one colour, the second another, with a disc that moves to
    the right. A codec-backed source would read its container in read() instead.
    """

    @classmethod
    def name(cls) -> str:
        return "shotloom_video"

    def schema(self) -> str:
        return "frame_idx int, pts bigint, time_sec double, w int, h int, img binary"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    STEP = 30

    def __init__(self, options):
        get = lambda k, d: float(options.get(k, d))
        self.fps, self.w, self.h = get("fps", 30), int(get("width", 640)), int(get("height", 360))
        self.n = int(get("seconds", 3) * self.fps)
        self.pixels = options.get("pixels", "false").lower() == "true"

    def partitions(self):
        return [InputPartition((a, min(self.n, a + self.STEP))) for a in range(0, self.n, self.STEP)]

    def read(self, partition):
        import numpy as np

        for i in range(*partition.value):
            img = None
            if self.pixels:
                y, x = np.ogrid[: self.h, : self.w]
                picture = np.empty((self.h, self.w, 3), np.uint8)
                picture[:] = (40, 40, 200) if i < self.n / 2 else (40, 200, 40)
                picture[(x - self.w * i / self.n) ** 2 + (y - self.h / 2) ** 2 < (self.h / 8) ** 2] = 255
                img = picture.tobytes()
            yield i, i, i / self.fps, self.w, self.h, img


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("shotloom_video")` known."""
    spark.dataSource.register(SyntheticVideo)
