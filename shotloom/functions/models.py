"""Where models and pixels plug in: detectors, embedders and pixel operations as vectorised functions.

A factory builds the model once for each worker process; nothing loads at import.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DETECTION = "key long, frame_idx int, face_ord int, x1 int, y1 int, x2 int, y2 int, confidence double, landmarks array<struct<x:double,y:double>>, error string"
#: The five reference points of an aligned 112 x 112 face.
TEMPLATE = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def detect(frames: DataFrame, factory: Callable[[], Callable]) -> DataFrame:
    """frames (key, frame_idx, w, h, img) -> a row for each face that factory()(image) finds.

    The detector returns (boxes, landmarks, confidences), as long as the shortest.
    Anything else, or a failure, gives no face but one row with the error.
    """

    def run(batches):
        model = factory()
        for b in batches:
            out = []
            for key, at, w, h, img in zip(*(b.column(c).to_pylist() for c in ("key", "frame_idx", "w", "h", "img"))):
                try:
                    found = model(np.frombuffer(img, np.uint8).reshape(h, w, 3))
                    if not (isinstance(found, tuple) and len(found) == 3):
                        raise TypeError("a detector returns boxes, landmarks and confidences")
                    for i, (box, marks, conf) in enumerate(zip(*found)):
                        out.append((key, at, i, *(int(v) for v in box[:4]), float(conf), [{"x": float(x), "y": float(y)} for x, y in marks], None))
                except Exception as e:  # noqa: BLE001  a frame that fails doesn't end the scan
                    out.append((key, at, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
            kinds = [pa.int64(), *[pa.int32()] * 6, pa.float64(), pa.list_(point), pa.string()]
            names = ["key", "frame_idx", "face_ord", "x1", "y1", "x2", "y2", "confidence", "landmarks", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 10, kinds)], names)

    return frames.select("key", "frame_idx", "w", "h", "img").mapInArrow(run, DETECTION)


def embed(crops: DataFrame, factory: Callable[[], Callable], batch: int = 32, length: int = 512) -> DataFrame:
    """crops (id, w, h, img) -> (id, embedding): batches of images through factory(), L2-normalised; zero vectors stay.

    A crop that isn't 112 x 112, or a vector of another length or with non-finite components, fails.
    """

    def run(batches):
        model = factory()
        for b in batches:
            ids, images = b.column("id").to_pylist(), []
            for w, h, img in zip(*(b.column(c).to_pylist() for c in ("w", "h", "img"))):
                if (w, h) != (112, 112):
                    raise ValueError(f"an aligned crop is 112 x 112, not {w} x {h}")
                images.append(np.frombuffer(img, np.uint8).reshape(h, w, 3))
            out = []
            for i in range(0, len(images), batch):
                v = np.asarray(model(np.stack(images[i : i + batch])), np.float32)
                if v.ndim != 2 or v.shape[1] != length or not np.isfinite(v).all():
                    raise ValueError("embeddings must be finite vectors of the stated length")
                n = np.linalg.norm(v, axis=1, keepdims=True)
                out += list(v / np.where(n == 0, 1, n))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tolist() for x in out], pa.list_(pa.float32()))], ["id", "embedding"])

    return crops.select("id", "w", "h", "img").mapInArrow(run, "id long, embedding array<float>")


def similarity_transform(points: np.ndarray, template: np.ndarray = TEMPLATE) -> np.ndarray:
    """The 2 x 3 matrix that turns, scales and moves five points onto the template with least squares."""
    points = np.asarray(points, np.float64)
    if points.shape != (5, 2):
        raise ValueError("exactly five landmarks are needed")
    p, q = points - points.mean(0), template - template.mean(0)
    a, b = (p * q).sum(), (p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum()
    m = np.array([[a, -b], [b, a]]) / (p * p).sum()
    return np.column_stack((m, template.mean(0) - m @ points.mean(0)))


def warp(image: np.ndarray, matrix: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """The image through a 2 x 3 matrix, bilinear, black outside. size is (width, height)."""
    inverse = np.linalg.inv(np.vstack((matrix, [0, 0, 1])))
    y, x = np.mgrid[: size[1], : size[0]]
    sx, sy = (inverse[i, 0] * x + inverse[i, 1] * y + inverse[i, 2] for i in range(2))
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    h, w = image.shape[:2]

    def at(yy, xx):
        inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        return np.where(inside[..., None], image[yy.clip(0, h - 1), xx.clip(0, w - 1)], 0)

    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    return image[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]


CROPS = "id long, w int, h int, img binary, error string"


def _crops(rows: DataFrame, columns: list[str], make: Callable) -> DataFrame:
    """id and what make(image, other columns) cuts from each row's image, or why it can't."""

    def run(batches):
        for b in batches:
            out = []
            for key, w, h, img, *rest in zip(*(b.column(c).to_pylist() for c in ("id", "w", "h", "img", *columns))):
                try:
                    got = make(np.frombuffer(img, np.uint8).reshape(h, w, 3), *rest)
                    out.append((key, got.shape[1], got.shape[0], np.ascontiguousarray(got).tobytes(), None))
                except Exception as e:  # noqa: BLE001  a face that can't be cut doesn't end the scan
                    out.append((key, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["id", "w", "h", "img", "error"])

    return rows.select("id", "w", "h", "img", *columns).mapInArrow(run, CROPS)


def aligned(faces: DataFrame, size: int = 112) -> DataFrame:
    """faces (id, w, h, img, landmarks) -> (id, w, h, img, error): each face turned, scaled and moved onto the template."""
    return _crops(faces, ["landmarks"], lambda image, marks: warp(image, similarity_transform([(p["x"], p["y"]) for p in marks], TEMPLATE * (size / 112)), (size, size)))


def cropped(faces: DataFrame) -> DataFrame:
    """faces (id, w, h, img, x1, y1, x2, y2) -> (id, w, h, img, error): the pixels inside each box; an empty crop is an error."""

    def cut(image, *box):
        got = crop(image, *box)
        if not got.size:
            raise ValueError("the box lies outside the image")
        return got

    return _crops(faces, ["x1", "y1", "x2", "y2"], cut)
