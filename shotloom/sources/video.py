"""Videos in container files: the bytes come from Spark's binaryFile source, a decoder plug-in reads them.

A factory makes the function `open(bytes)` once for each worker. What it returns
has fps, tb_num, tb_den, width, height and n_frames (None if unknown), seek(seconds),
iterates (pts, seconds, image) - either stamp may be None, image is h x w x 3 - and
has close(). Y4M is the decoder that comes with the engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

INFO = "path string, fps double, tb_num int, tb_den int, w int, h int, n_frames int, error string"
FRAMES = "path string, frame_idx int, pts bigint, time_sec double, w int, h int, img binary"
#: Frames that a decode starts before the first one wanted.
PREROLL = 5


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of container files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


class Y4M:
    """An uncompressed YUV4MPEG2 stream: 8 bits, 4:4:4 or 4:2:0; frames are numbered, one tick each."""

    def __init__(self, data: bytes):
        head, _, rest = data.partition(b"\n")
        fields = head.decode("ascii", "replace").split(" ")
        if fields[0] != "YUV4MPEG2":
            raise ValueError("not a YUV4MPEG2 stream")
        given = {f[0]: f[1:] for f in fields[1:] if f}
        self.width, self.height = int(given["W"]), int(given["H"])
        num, den = map(int, given.get("F", "30:1").split(":"))
        self.fps, self.tb_num, self.tb_den = num / den, den, num
        self.dense = given.get("C", "420").startswith("444")
        if not self.dense and not given.get("C", "420").startswith("420"):
            raise ValueError(f"chroma {given['C']} isn't read")
        self.chroma = (self.width, self.height) if self.dense else ((self.width + 1) // 2, (self.height + 1) // 2)
        self.data, self.start, self.next = data, len(head) + 1, 0
        self.size = self.width * self.height + 2 * self.chroma[0] * self.chroma[1]
        # frame headers may carry parameters, so their places are found once
        self.places, at = [], self.start
        while data[at : at + 5] == b"FRAME":
            at = data.index(b"\n", at) + 1
            if at + self.size > len(data):
                break
            self.places.append(at)
            at += self.size
        self.n_frames = len(self.places)

    def seek(self, seconds: float) -> None:
        self.next = min(self.n_frames, max(0, math.floor(seconds * self.fps + 1e-9)))

    def __iter__(self) -> Iterator[tuple]:
        while self.next < self.n_frames:
            i, self.next = self.next, self.next + 1
            yield i, i / self.fps, self._image(i)

    def _image(self, i: int) -> np.ndarray:
        raw = np.frombuffer(self.data, np.uint8, self.size, self.places[i]).astype(np.float32)
        n, (cw, ch) = self.width * self.height, self.chroma
        y = raw[:n].reshape(self.height, self.width)
        u, v = (raw[n + k * cw * ch : n + (k + 1) * cw * ch].reshape(ch, cw) - 128 for k in (0, 1))
        if not self.dense:
            u, v = (c.repeat(2, 0).repeat(2, 1)[: self.height, : self.width] for c in (u, v))
        bgr = np.stack((y + 1.772 * u, y - 0.344136 * u - 0.714136 * v, y + 1.402 * v), -1)
        return np.clip(np.rint(bgr), 0, 255).astype(np.uint8)

    def close(self) -> None:
        self.data = b""


def y4m() -> Callable[[bytes], Y4M]:
    return Y4M


def video_info(videos: DataFrame, factory: Callable[[], Callable] = y4m) -> DataFrame:
    """videos (path, content) -> what each container says of itself; a file that can't be opened gives a row with the error."""

    def run(batches):
        opener = factory()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    video = opener(content.as_py())
                    row = (path, video.fps, video.tb_num, video.tb_den, video.width, video.height, video.n_frames, None)
                    video.close()
                except Exception as e:  # noqa: BLE001  one broken file doesn't end the scan
                    row = (path, *[None] * 6, f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_pylist([dict(zip(info.names, row))], info)

    info = pa.schema([("path", pa.string()), ("fps", pa.float64()), *((n, pa.int32()) for n in ("tb_num", "tb_den", "w", "h", "n_frames")), ("error", pa.string())])
    return videos.select("path", "content").mapInArrow(run, INFO)


def read_frames(videos: DataFrame, first: int = 0, last: int | None = None, pixels: bool = True, factory: Callable[[], Callable] = y4m, batch: int = 16) -> DataFrame:
    """videos (path, content) -> frames first to last (both included) of each, in order; none if last < first.

    The decode seeks PREROLL frames early and skips what comes before the first
    frame: by pts where a frame has one, else by time, else by count. A seek that
    fails starts the file over and counts from its start. One task decodes one file.
    """
    if last is not None and last < first:
        return videos.sparkSession.createDataFrame([], FRAMES)

    def selected(opener, content: bytes):
        video, counted = opener(content), 0
        start = first / video.fps
        try:
            if first:
                early = max(0, first - PREROLL)
                video.seek(early / video.fps)
                counted = early
        except Exception:  # noqa: BLE001  a decoder that can't seek reads from the start
            video.close()
            video, counted = opener(content), 0
        wanted, at = None if last is None else last - first + 1, first
        tick = round(start * video.tb_den / video.tb_num)
        for pts, seconds, image in video:
            late = pts >= tick if pts is not None else seconds + 1e-9 >= start if seconds is not None else counted >= first
            counted += 1
            if not late:
                continue
            if wanted is not None and at - first >= wanted:
                break
            yield at, pts, seconds, video.width, video.height, image
            at += 1
        video.close()

    def run(batches):
        opener = factory()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                held = []
                for at, pts, seconds, w, h, image in selected(opener, content.as_py()):
                    held.append(dict(zip(kind.names, (path, at, pts, seconds, w, h, image.tobytes() if pixels else None))))
                    if len(held) == batch:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    kind = pa.schema([("path", pa.string()), ("frame_idx", pa.int32()), ("pts", pa.int64()), ("time_sec", pa.float64()), ("w", pa.int32()), ("h", pa.int32()), ("img", pa.binary())])
    return videos.select("path", "content").mapInArrow(run, FRAMES)


def written_y4m(frames: DataFrame, key: str, order: str, fps: int) -> DataFrame:
    """frames (key, order, w, h, img) -> (key, content): each key's frames in order as one 4:4:4 stream, a row; a video is one file."""

    def write(table: pa.Table) -> pa.Table:
        rows = table.sort_by(order)
        w, h = rows["w"][0].as_py(), rows["h"][0].as_py()
        out = [f"YUV4MPEG2 W{w} H{h} F{fps}:1 Ip A1:1 C444\n".encode()]
        for img in rows["img"]:
            b, g, r = np.frombuffer(img.as_py(), np.uint8).reshape(h, w, 3).astype(np.float32).transpose(2, 0, 1)
            y = 0.299 * r + 0.587 * g + 0.114 * b
            planes = np.stack((y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128))
            out += [b"FRAME\n", np.clip(np.rint(planes), 0, 255).astype(np.uint8).tobytes()]
        return pa.table({key: pa.array([table[key][0].as_py()], table[key].type), "content": pa.array([b"".join(out)], pa.binary())})

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, order, "w", "h", "img").groupBy(key).applyInArrow(write, f"{key} {kind}, content binary")
