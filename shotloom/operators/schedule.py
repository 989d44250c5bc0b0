"""When a shot's frames are detected and when they are tracked, over detection and tracking results given as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.groups import scan_sorted


def due(frame: Column, first: Column | int, interval: int) -> Column:
    """Frames that are detected in any case: every interval-th of the shot."""
    return F.pmod(frame - first, F.lit(interval)) == 0


OUT = T.StructType([
    T.StructField("shot_id", T.LongType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("action", T.StringType()),
    T.StructField("n_faces", T.IntegerType()), T.StructField("closes", T.BooleanType()),
])


def shot_schedule(frames: DataFrame, interval: int) -> DataFrame:
    """frames (shot_id, frame_idx, detected, tracked_ok) -> (shot_id, frame_idx, action, n_faces, closes).

    detected is how many boxes a detection of the frame gives (null: none), and
    tracked_ok whether the trackers hold in it. Every interval-th frame of the
    shot is detected, as is every frame until there is a track; without active
    trackers the frame is detected, too. If a tracker fails, all open tracks
    close (`closes`) and the frame is detected as a fallback.
    """

    def step(rows):
        any_track, active, tracked, i = False, False, 0, 0
        for shot, frame, detected, ok in rows:
            scheduled = i % interval == 0 or not any_track
            closes = False
            if scheduled or not active:
                action = "detected"
            elif ok:
                action = "tracked"
            else:
                action, closes = "fallback", True
            faces = tracked if action == "tracked" else detected or 0
            if action != "tracked":
                active, tracked = faces > 0, faces
            any_track = any_track or faces > 0
            i += 1
            yield shot, frame, action, faces, closes

    own = frames.select(F.col("shot_id").cast("long"), F.col("frame_idx").cast("int"), F.col("detected").cast("int"), F.coalesce(F.col("tracked_ok"), F.lit(False)).alias("ok"))
    return scan_sorted(own, ["shot_id"], ["frame_idx"], step, OUT)


def frame_face_schedule(frames: DataFrame, interval: int, dedupe: bool = False) -> DataFrame:
    """frames (shot_id, frame_idx, detected, tracked_ok) as above, for per-frame face lists.

    A frame is detected if the one before had no face, and every interval-th.
    Otherwise faces are tracked; with a lost tracker the surviving boxes stay and
    the detections come on top (`fallback`); dedupe leaves only the detections.
    tracked_ok may be a count of surviving trackers or a boolean for all or none.
    """
    boolean = dict(frames.dtypes)["tracked_ok"] == "boolean"

    def step(rows):
        before, trackers = 0, 0
        for shot, frame, detected, kept in rows:
            kept = trackers if boolean and kept else 0 if boolean or kept is None else min(kept, trackers)
            if not before or frame % interval == 0:
                action, faces = "detected", detected or 0
                trackers = faces or trackers
            elif kept == trackers:
                action, faces = "tracked", kept
            else:
                action, faces = "fallback", (0 if dedupe else kept) + (detected or 0)
                trackers = detected or trackers
            before = faces
            yield shot, frame, action, faces, False

    own = frames.select(F.col("shot_id").cast("long"), F.col("frame_idx").cast("int"), F.col("detected").cast("int"), "tracked_ok")
    return scan_sorted(own, ["shot_id"], ["frame_idx"], step, OUT)


def mouth_schedule(frames: DataFrame, interval: int) -> DataFrame:
    """frames (shot_id, frame_idx, detected, drawn, tracked_ok) -> the schedule of a renderer that draws faces and mouths.

    A frame is detected if the one before had no face, and every interval-th.
    Otherwise trackers are counted; if one is lost the frame is detected as a
    fallback, whose drawn faces (`drawn`, of the boxes in `detected`) replace the
    count, unless it finds none. tracked_ok as in frame_face_schedule().
    """
    boolean = dict(frames.dtypes)["tracked_ok"] == "boolean"

    def step(rows):
        before, trackers = 0, 0
        for shot, frame, detected, drawn, kept in rows:
            kept = trackers if boolean and kept else 0 if boolean or kept is None else min(kept, trackers)
            if not before or frame % interval == 0:
                action, faces = "detected", (drawn or 0) if detected else 0
            elif kept == trackers:
                action, faces = "tracked", kept
            else:
                action, faces = "fallback", (drawn or 0) if detected else kept
            if action != "tracked":
                trackers = detected or trackers
            before = faces
            yield shot, frame, action, faces, False

    own = frames.select(F.col("shot_id").cast("long"), F.col("frame_idx").cast("int"), F.col("detected").cast("int"), F.col("drawn").cast("int"), "tracked_ok")
    return scan_sorted(own, ["shot_id"], ["frame_idx"], step, OUT)
