"""Where trackers and optical flow plug in: a detector and trackers run over each shot's frames in order.

A tracker factory makes `start(image, box)` once for each worker; what that returns
has update(image) -> (held, box). Frames stream in; only open trackers are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.groups import scan_sorted

BOX = [T.StructField(s, T.IntegerType()) for s in ("x1", "y1", "x2", "y2")]
OUT = T.StructType([T.StructField("shot_id", T.LongType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("action", T.StringType()), T.StructField("track_id", T.IntegerType()), *BOX])


def _images(frames: DataFrame) -> DataFrame:
    return frames.select(F.col("shot_id").cast("long"), F.col("frame_idx").cast("int"), "w", "h", "img")


def _image(w: int, h: int, img: bytes) -> np.ndarray:
    return np.frombuffer(img, np.uint8).reshape(h, w, 3)


def track(frames: DataFrame, detector: Callable[[], Callable], tracker: Callable[[], Callable], interval: int) -> DataFrame:
    """frames (shot_id, frame_idx, w, h, img) -> (shot_id, frame_idx, action, track_id, box) for each face of each frame.

    As shot_schedule(), with results instead of rows: every interval-th frame of
    a shot is detected, as is every frame while no tracker is active; other frames
    are tracked. If a tracker is lost, all close and the frame is detected as a
    fallback. Each detection starts trackers anew, with new track ids in the shot.
    A frame without a face gives one row without track_id and box.
    """

    def step(rows):
        detect, start = detector(), tracker()
        active, number, i, born = [], 0, 0, False
        for shot, frame, w, h, img in rows:
            image, action = _image(w, h, img), "tracked"
            if i % interval == 0 or not born or not active:
                action = "detected"
            else:
                moved = [(t, *follow.update(image)) for t, follow in active]
                if not all(held for _, held, _ in moved):
                    action = "fallback"
                else:
                    found = [(t, tuple(int(v) for v in box)) for t, _, box in moved]
            if action != "tracked":
                boxes = [tuple(int(v) for v in b) for b in detect(image)]
                found = [(number + k, b) for k, b in enumerate(boxes)]
                active = [(t, start(image, b)) for t, b in found]
                number += len(boxes)
            born, i = born or bool(found), i + 1
            if not found:
                yield shot, frame, action, None, None, None, None, None
            for t, box in found:
                yield shot, frame, action, t, *box

    return scan_sorted(_images(frames), ["shot_id"], ["frame_idx"], step, OUT)


class Template:
    """A tracker without a model: the place near the last box where the first box's pixels fit best."""

    def __init__(self, image: np.ndarray, box, reach: int = 8, worst: float = 20.0):
        x1, y1, x2, y2 = box
        self.patch, self.box, self.reach, self.worst = image[y1:y2, x1:x2].astype(np.int16), box, reach, worst

    def update(self, image: np.ndarray):
        x1, y1, x2, y2 = self.box
        h, w = image.shape[:2]
        best = None
        for dy in range(-self.reach, self.reach + 1):
            for dx in range(-self.reach, self.reach + 1):
                a, b = x1 + dx, y1 + dy
                if a < 0 or b < 0 or x2 + dx > w or y2 + dy > h:
                    continue
                error = np.abs(image[b : y2 + dy, a : x2 + dx].astype(np.int16) - self.patch).mean()
                rank = (error, dx * dx + dy * dy, dy, dx)
                if best is None or rank < best:
                    best = rank
        if best is None or best[0] > self.worst:
            return False, self.box
        self.box = (x1 + best[3], y1 + best[2], x2 + best[3], y2 + best[2])
        return True, self.box


def flow(frames: DataFrame, points: DataFrame, factory: Callable[[], Callable]) -> DataFrame:
    """(shot_id, frame_idx, point, x, y, found): points of each shot's first frame followed from frame to frame.

    points is (shot_id, point, x, y). factory() makes follow(before, now, points)
    -> (points, found), for n x 2 arrays. A lost point keeps its place and stays lost.
    """
    listed = points.groupBy(F.col("shot_id").cast("long").alias("shot_id")).agg(F.sort_array(F.collect_list(F.struct("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("points"))
    out = T.StructType([T.StructField("shot_id", T.LongType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("point", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("found", T.BooleanType())])

    def step(rows):
        follow, before = factory(), None
        for shot, frame, w, h, img, own in rows:
            image = _image(w, h, img)
            if before is None:
                names = [p["point"] for p in own or ()]
                at, alive = np.array([(p["x"], p["y"]) for p in own or ()], np.float64).reshape(-1, 2), np.ones(len(names), bool)
            elif alive.any():
                moved, found = follow(before, image, at[alive])
                held = np.flatnonzero(alive)
                at[held[np.asarray(found, bool)]] = np.asarray(moved, np.float64)[np.asarray(found, bool)]
                alive[held] = found
            before = image
            for n, (x, y), ok in zip(names, at.tolist(), alive.tolist()):
                yield shot, frame, n, x, y, ok

    # the points travel with the frames of their shot: as many as a shot has in its first frame
    return scan_sorted(_images(frames).join(listed, "shot_id", "left"), ["shot_id"], ["frame_idx"], step, out)
