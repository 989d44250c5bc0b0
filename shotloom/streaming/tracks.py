"""Tracks and shots over streams: the batch operators' results, emitted as tracks close.

Rows may come in any order within the watermark's delay. A shot's state holds
the observations that the watermark hasn't passed, and its open tracks; frames
are linked in order once the watermark is beyond them, so the result equals the
batch result whatever the micro-batches are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import SIDES
from ..operators.tracking import TrackLinker

CLOSED = "shot_id long, track_id int, first_frame int, last_frame int, n_obs long"


def with_event_time(observations: DataFrame, fps: float = 1.0, start: int = 0) -> DataFrame:
    """A synthetic event time, start (seconds since the epoch) + frame_idx / fps."""
    return observations.withColumn("event_time", F.timestamp_micros(((F.lit(start) + F.col("frame_idx") / fps) * 1_000_000).cast("long")))


class _Shot:
    """A shot's linker, waiting observations by frame, and the spans of its open tracks."""

    def __init__(self, threshold: float, conflict: str):
        self.linker = TrackLinker(threshold, conflict)
        self.waiting: dict[int, list[tuple]] = {}
        self.spans: dict[int, list[int]] = {}
        self.now: int | None = None

    def advance(self, end: int | None) -> list[tuple]:
        """Link the waiting frames before end (None: all), and return the tracks that are closed."""
        for frame in sorted(f for f in self.waiting if end is None or f < end):
            if self.now is not None and frame > self.now + 1:
                self.linker.frame([])
            rows = sorted(self.waiting.pop(frame))
            for track, _ in zip(self.linker.frame([r[1:] for r in rows]), rows):
                span = self.spans.setdefault(track, [frame, frame, 0])
                span[1], span[2] = frame, span[2] + 1
            self.now = frame
        if self.now is not None and (end is None or end > self.now + 1):
            self.linker.frame([])  # the frame after the last one linked is past, without observations
        closed = [t for t in self.spans if t not in self.linker.open]
        return [(t, *self.spans.pop(t)) for t in closed]


def stream_tracks(observations: DataFrame, delay: str = "5 seconds", fps: float = 1.0, start: int = 0, threshold: float = 0.5, conflict: str = "error") -> DataFrame:
    """A stream of observations (shot_id, frame_idx, obs_ord, box, event_time) -> closed tracks, append mode.

    A track is emitted when the watermark is beyond the frame after its last. Rows
    later than the watermark are dropped by Spark. Every integer frame counts as
    processed, as in link_tracks() without frames.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shot: _Shot = pickle.loads(state.get[0]) if state.exists else _Shot(threshold, conflict)
        for pdf in batches:
            for r in pdf[["frame_idx", "obs_ord", *SIDES]].itertuples(index=False):
                shot.waiting.setdefault(int(r[0]), []).append(tuple(map(int, r[1:])))
        mark = state.getCurrentWatermarkMs()
        out = shot.advance(_frames_before(mark, fps, start)) if mark > 0 else []
        state.update((pickle.dumps(shot),))
        pending = [*shot.waiting, *(span[1] + 1 for span in shot.spans.values())]
        if pending:  # wake up once the watermark is beyond the next frame that matters
            state.setTimeoutTimestamp(max(int((start + (min(pending) + 1) / fps) * 1000), mark + 1))
        yield pd.DataFrame([(key[0], *t) for t in out], columns=["shot_id", "track_id", "first_frame", "last_frame", "n_obs"])

    stream = observations.select("shot_id", "frame_idx", "obs_ord", *SIDES, "event_time").withWatermark("event_time", delay)
    return stream.groupBy("shot_id").applyInPandasWithState(update, CLOSED, "shot binary", "append", GroupStateTimeout.EventTimeTimeout)


def _frames_before(mark_ms: int, fps: float, start: int) -> int:
    """The first frame whose event time the watermark hasn't passed."""
    return int(-(-(mark_ms / 1000 - start) * fps // 1))


def stream_counts(observations: DataFrame, width: str = "10 seconds", delay: str = "5 seconds") -> DataFrame:
    """Observations and distinct shots (approximate) in tumbling windows of event time; windows close with the watermark."""
    return observations.withWatermark("event_time", delay).groupBy(F.window("event_time", width)).agg(F.count("*").alias("n_obs"), F.approx_count_distinct("shot_id").alias("n_shots")).select("window.start", "window.end", "n_obs", "n_shots")


class _Cuts:
    """A stream's frames that wait for the watermark, and the open segment: (number, first, last, n, last value)."""

    def __init__(self):
        self.waiting: dict[int, float | None] = {}
        self.open: tuple | None = None


def stream_segments(frames: DataFrame, key: str, feature: str, threshold: float = 30.0, delay: str = "5 seconds", fps: float = 1.0, start: int = 0) -> DataFrame:
    """A stream of frames (key, frame_idx, feature, event_time) -> segments as they end, append mode.

    A segment is emitted with the first frame of the next one, once the watermark
    has passed that frame. Frames without a value don't cut.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cuts: _Cuts = pickle.loads(state.get[0]) if state.exists else _Cuts()
        for pdf in batches:
            for at, value in zip(pdf["frame_idx"], pdf[feature]):
                cuts.waiting[int(at)] = None if pd.isna(value) else float(value)
        mark = state.getCurrentWatermarkMs()
        end = _frames_before(mark, fps, start) if mark > 0 else 0
        out = []
        for at in sorted(f for f in cuts.waiting if f < end):
            value = cuts.waiting.pop(at)
            if cuts.open is None:
                cuts.open = (1, at, at, 1, value)
                continue
            number, first, last, n, before = cuts.open
            if value is not None and before is not None and abs(value - before) > threshold:
                out.append((number, first, last, n))
                cuts.open = (number + 1, at, at, 1, value)
            else:
                cuts.open = (number, first, at, n + 1, value)
        state.update((pickle.dumps(cuts),))
        if cuts.waiting:
            state.setTimeoutTimestamp(max(int((start + (min(cuts.waiting) + 1) / fps) * 1000), mark + 1))
        yield pd.DataFrame([(group[0], *o) for o in out], columns=[key, "shot_number", "first_frame", "last_frame", "n"])

    kind = dict(frames.dtypes)[key]
    stream = frames.select(key, "frame_idx", feature, "event_time").withWatermark("event_time", delay)
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, shot_number int, first_frame int, last_frame int, n long", "cuts binary", "append", GroupStateTimeout.EventTimeTimeout)
