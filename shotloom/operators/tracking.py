"""Linking observations of a shot into tracks, frame by frame, and what is derived from tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import SIDES
from ..plans.groups import scan_sorted


def overlap_share(a, b) -> float:
    """Intersection over union of two boxes given as tuples; 0 where the union is empty."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = w * h if w > 0 and h > 0 else 0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union else 0.0


class TrackLinker:
    """The state of one shot: open tracks with their last box, oldest first.

    frame() takes the boxes of one processed frame, in order, and returns their
    track ids. Each box goes to the open track with the greatest overlap with its
    last box, if that reaches the threshold; the oldest wins ties. Boxes without
    one open tracks after all have been matched, and tracks without a box close.
    Two boxes that go to one track are a conflict: `error` fails, `first_wins`
    leaves the track to the first.
    """

    def __init__(self, threshold: float = 0.5, conflict: str = "error"):
        if conflict not in ("error", "first_wins"):
            raise ValueError(f"no such conflict policy: {conflict}")
        self.threshold, self.conflict = threshold, conflict
        self.open: dict[int, tuple] = {}
        self.next_id = 0

    def frame(self, boxes: list[tuple]) -> list[int]:
        found: list[int | None] = []
        touched: set[int] = set()
        for box in boxes:
            best, most = None, 0.0
            for track, last in self.open.items():
                if self.conflict == "first_wins" and track in touched:
                    continue
                share = overlap_share(last, box)
                if share > most and share >= self.threshold:
                    best, most = track, share
            if best is not None:
                if best in touched:
                    raise ValueError(f"two observations of one frame match track {best}")
                touched.add(best)
                self.open[best] = box
            found.append(best)
        born = {}
        for i, track in enumerate(found):
            if track is None:
                found[i] = self.next_id
                born[self.next_id] = boxes[i]
                self.next_id += 1
        self.open = {t: b for t, b in self.open.items() if t in touched} | born
        return found


TRACKED = T.StructType([
    T.StructField("shot_id", T.LongType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("obs_ord", T.LongType()),
    *[T.StructField(s, T.IntegerType()) for s in SIDES], T.StructField("track_id", T.IntegerType()),
])


def link_tracks(observations: DataFrame, frames: DataFrame | None = None, threshold: float = 0.5, conflict: str = "error", ref: str | None = None) -> DataFrame:
    """observations (shot_id, frame_idx, obs_ord, x1..y2) -> the same with track_id, numbered in each shot.

    frames (shot_id, frame_idx) names the processed frames: a processed frame
    without an observation of a track closes it. Without frames every integer
    frame is processed. Frames run in order of frame_idx, observations of a frame
    in order of obs_ord. State is held for open tracks only, in one sorted pass.
    ref is a column of numbers that goes along, for columns that would be heavy.
    """
    own = observations.select(F.col("shot_id").cast("long"), F.col("frame_idx").cast("int"), F.col("obs_ord").cast("long"), *[F.col(s).cast("int") for s in SIDES], *([F.col(ref).cast("long")] if ref else []))
    schema = T.StructType([*TRACKED.fields[:-1], *([T.StructField(ref, T.LongType())] if ref else []), TRACKED.fields[-1]])
    dense = frames is None
    if not dense:
        marks = frames.select(F.col("shot_id").cast("long"), F.col("frame_idx").cast("int")).distinct()
        own = own.unionByName(marks.withColumns({"obs_ord": F.lit(None).cast("long"), **{s: F.lit(None).cast("int") for s in SIDES}, **({ref: F.lit(None).cast("long")} if ref else {})}))

    def step(rows):
        linker, now, held = TrackLinker(threshold, conflict), None, []

        def close():
            for r, track in zip(held, linker.frame([r[3:7] for r in held])):
                yield (*r, track)

        for r in rows:
            if now is not None and r[1] != now:
                yield from close()
                held.clear()
                if dense and r[1] != now + 1:
                    linker.frame([])
            now = r[1]
            if r[3] is not None:
                held.append(r)
        yield from close()

    return scan_sorted(own, ["shot_id"], ["frame_idx", F.col("obs_ord").asc_nulls_first()], step, schema)


KEYS = ["shot_id", "track_id"]


def tracks(tracked: DataFrame) -> DataFrame:
    """(shot_id, track_id, first_frame, last_frame, n_obs): one row for each track."""
    return tracked.groupBy(*KEYS).agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n_obs"))


def track_summary(tracked: DataFrame) -> DataFrame:
    """Frames, duration, first and last box and the mean box of each track."""
    place = F.struct("frame_idx", "obs_ord")
    box = F.struct(*SIDES)
    out = tracked.groupBy(*KEYS).agg(
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n_obs"),
        F.min_by(box, place).alias("first"), F.max_by(box, place).alias("last"), *[F.avg(s).alias(f"mean_{s}") for s in SIDES],
    )
    return out.select(
        *KEYS, "first_frame", "last_frame", (F.col("last_frame") - F.col("first_frame") + 1).alias("duration"), "n_obs",
        *[F.col(f"first.{s}").alias(f"first_{s}") for s in SIDES], *[F.col(f"last.{s}").alias(f"last_{s}") for s in SIDES], *[f"mean_{s}" for s in SIDES],
    )


def track_frames(tracked: DataFrame) -> DataFrame:
    """(shot_id, track_id, frames): the frames of each track in order, repeats kept."""
    return tracked.groupBy(*KEYS).agg(F.sort_array(F.collect_list("frame_idx")).alias("frames"))


def overlaps(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    """Whether two closed intervals share a frame."""
    return ~((last_a < first_b) | (last_b < first_a))


def box_at(tracked: DataFrame, frame: Column | int) -> DataFrame:
    """Each track's box in a frame, the latest if there are several; tracks without one have no row."""
    box = F.struct(*SIDES)
    return tracked.where(F.col("frame_idx") == frame).groupBy(*KEYS).agg(F.max_by(box, "obs_ord").alias("box"))


def box_number(tracked: DataFrame, position: int) -> DataFrame:
    """Each track's box by position among its observations; null where there is none, and for negative positions."""
    ordered = F.sort_array(F.collect_list(F.struct("frame_idx", "obs_ord", F.struct(*SIDES).alias("box"))))
    listed = tracked.groupBy(*KEYS).agg(ordered.alias("_all"))
    return listed.select(*KEYS, (F.get("_all", F.lit(position))["box"] if position >= 0 else F.lit(None)).alias("box"))


def repeated_frames(tracked: DataFrame) -> DataFrame:
    """Violations: (shot_id, track_id, frame_idx, n) where a track has several observations of a frame."""
    return tracked.groupBy(*KEYS, "frame_idx").agg(F.count("*").alias("n")).where("n > 1")


#: Frames in a block of overlap_pairs().
BLOCK = 16


def overlap_pairs(summary: DataFrame) -> DataFrame:
    """Pairs of tracks of a shot whose intervals share a frame: (shot_id, track_a, track_b).

    The join is on the shot and on blocks of BLOCK frames, so that it stays an
    equi-join; a pair is kept in the block where the later of the two starts.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    spread = summary.select(*KEYS, "first_frame", "last_frame", F.explode(F.sequence(block("first_frame"), block("last_frame"))).alias("_b"))
    a, b = (spread.select("shot_id", "_b", *[F.col(c).alias(f"{c}_{s}") for c in ("track_id", "first_frame", "last_frame")]) for s in "ab")
    start = F.greatest("first_frame_a", "first_frame_b")
    met = a.join(b, ["shot_id", "_b"]).where((F.col("track_id_a") < F.col("track_id_b")) & overlaps(*map(F.col, ("first_frame_a", "last_frame_a", "first_frame_b", "last_frame_b"))))
    return met.where(F.floor(start / BLOCK) == F.col("_b")).select("shot_id", F.col("track_id_a").alias("track_a"), F.col("track_id_b").alias("track_b"))


def expanded_boxes(boxes: DataFrame, width: int, height: int, keys: list[str], order: str, margin: int = 20) -> DataFrame:
    """Each box grown on every side by the larger of the margin and the room it has, clipped to the image.

    The room is the distance to the image's border or to the nearest box of the
    same frame that lies fully on that side; boxes equal by value aren't neighbours.
    """
    other = boxes.select(*keys, *[F.col(s).alias("o" + s) for s in SIDES]).distinct()
    near = boxes.join(other, keys, "left")
    differs = F.struct(*SIDES) != F.struct(*["o" + s for s in SIDES])
    gap = lambda condition, distance: F.min(F.when(differs & condition, distance))
    c = F.col
    grouped = near.groupBy(*keys, order, *SIDES).agg(
        gap(c("ox2") <= c("x1"), c("x1") - c("ox2")).alias("l"), gap(c("oy2") <= c("y1"), c("y1") - c("oy2")).alias("t"),
        gap(c("ox1") >= c("x2"), c("ox1") - c("x2")).alias("r"), gap(c("oy1") >= c("y2"), c("oy1") - c("y2")).alias("b"),
    )
    room = lambda border, side: F.greatest(F.least(border, c(side)), F.lit(margin))
    return grouped.select(
        *keys, order,
        F.greatest(F.lit(0), c("x1") - room(c("x1"), "l")).alias("ex1"), F.greatest(F.lit(0), c("y1") - room(c("y1"), "t")).alias("ey1"),
        F.least(F.lit(width), c("x2") + room(width - c("x2"), "r")).alias("ex2"), F.least(F.lit(height), c("y2") + room(height - c("y2"), "b")).alias("ey2"),
    )


def last_frames(tracked: DataFrame) -> DataFrame:
    """(shot_id, last_frame): the last frame that any track of a shot reaches; shots without tracks have no row."""
    return tracked.groupBy("shot_id").agg(F.max("frame_idx").cast("int").alias("last_frame"))


def claims(candidates: DataFrame, items: DataFrame, keys: list[str], score: Column, threshold: float, skip: Column | None = None) -> DataFrame:
    """Pairs of candidates and items of a group that score enough, ranked by score for each candidate, ties by item_ord.

    candidates have track_id, items item_ord; keys is what both share; skip leaves candidates out.
    """
    pairs = (candidates if skip is None else candidates.where(~skip)).join(items, keys)
    pairs = pairs.withColumn("score", score).where(F.col("score") >= threshold)
    order = Window.partitionBy(*keys, "track_id").orderBy(F.desc("score"), "item_ord")
    return pairs.withColumn("rank", F.row_number().over(order))


def resolve_claims(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """claims() with `assigned`: each candidate, by id, keeps its best item unless an earlier candidate has it; the rest lose."""
    schema = T.StructType([*[ranked.schema[k] for k in keys], ranked.schema["track_id"], ranked.schema["item_ord"], ranked.schema["rank"], T.StructField("assigned", T.BooleanType())])
    n = len(keys)

    def step(rows):
        used = set()
        for r in rows:
            fine = r[n + 2] == 1 and r[n + 1] not in used
            if fine:
                used.add(r[n + 1])
            yield (*r, fine)

    return scan_sorted(ranked.select(*keys, "track_id", "item_ord", "rank"), keys, ["track_id", "rank"], step, schema)
