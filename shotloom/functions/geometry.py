"""Box geometry as column expressions. A box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "", of: Column | None = None) -> tuple[Column, ...]:
    """The four columns of a box by name prefix, or the four fields of a struct."""
    return tuple(of[s] if of is not None else F.col(prefix + s) for s in SIDES)


def box_struct(b: Iterable[Column]) -> Column:
    return F.struct(*[c.alias(s) for c, s in zip(b, SIDES)])


def iou(a, b) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    side = lambda i: F.greatest(F.lit(0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    shared = side(0) * side(1)
    union = area(a) + area(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared.cast("double") / F.when(union == 0, F.lit(1)).otherwise(union))


def normalized(b, width, height) -> dict[str, Column]:
    """Centre and size in percent of the frame, unrounded."""
    per = lambda v, whole: F.lit(100.0) * v / whole
    return {
        "center_x": per((b[0] + b[2]) / 2, width), "center_y": per((b[1] + b[3]) / 2, height),
        "face_width": per(b[2] - b[0], width), "face_height": per(b[3] - b[1], height),
    }


def denormalized(cx, cy, fw, fh, width, height) -> tuple[Column, ...]:
    """Pixel corners of a box in percent, truncated."""
    px = lambda v, whole: v / 100 * whole
    return tuple((px(c, n) + sign * px(s, n) / 2).cast("int") for sign in (-1, 1) for c, s, n in ((cx, fw, width), (cy, fh, height)))


def to_xywh(b) -> tuple[Column, ...]:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def to_xyxy(x, y, w, h) -> tuple[Column, ...]:
    """Corners of a box given by origin and size, truncated after the addition."""
    return x.cast("int"), y.cast("int"), (x + w).cast("int"), (y + h).cast("int")


def inside_image(b, width, height) -> Column:
    """Origin strictly inside, far corner at most on the border."""
    return (b[0] >= 0) & (b[1] >= 0) & (b[0] < width) & (b[1] < height) & (b[2] <= width) & (b[3] <= height)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _field(k: str):
    return lambda p: p[k]


def _middle(k: str):
    return lambda f: (f[k + "1"] + f[k + "2"]) / 2


def mouth_box(landmarks: Column, pad: int = 5) -> tuple[Column, ...]:
    """(x, y, w, h) around the last three of five landmarks, padded; the origin is kept in the image. Fewer landmarks fail."""
    points = F.slice(landmarks, 3, 3)
    low, high = ({k: f(F.transform(points, _field(k))) for k in "xy"} for f in (F.array_min, F.array_max))
    checked = F.when(F.size(landmarks) < 5, F.raise_error(F.lit("at least 5 landmarks are needed")).cast("int"))
    return (
        checked.otherwise(F.greatest(F.lit(0), low["x"] - pad)), F.greatest(F.lit(0), low["y"] - pad),
        high["x"] - low["x"] + 2 * pad, high["y"] - low["y"] + 2 * pad,
    )


def mouth_inside(landmarks: Column, width: Column | int, height: Column | int) -> Column:
    """Whether the last three of five landmarks lie in the image; null landmarks give null."""
    return F.forall(F.slice(landmarks, 3, 3), lambda p: (p["x"] >= 0) & (p["x"] < width) & (p["y"] >= 0) & (p["y"] < height))


def mouth_midpoint(landmarks: Column) -> tuple[Column, ...]:
    """Mean of the two mouth corners, truncated."""
    return tuple(((landmarks[3][k] + landmarks[4][k]) / 2).cast("int") for k in "xy")


# Crop plans: where a portrait window of height / aspect lies, and how the frame is turned for it.

PLAN = "struct<kind:string,x1:int,y1:int,x2:int,y2:int,angle:double,scale:double>"


def _plan(kind: str, x1, y1, x2, y2, angle=0.0, scale=1.0) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), *[(c if isinstance(c, Column) else F.lit(c)).cast("int").alias(s) for c, s in zip((x1, y1, x2, y2), SIDES)],
        (angle if isinstance(angle, Column) else F.lit(float(angle))).cast("double").alias("angle"), (scale if isinstance(scale, Column) else F.lit(float(scale))).cast("double").alias("scale"),
    )


def _window(kind: str, left: Column, crop: int, width: int, height: int) -> Column:
    """A full-height window from `left`, moved inside the frame; wider than the frame, it is the frame."""
    moved = F.when(left < 0, 0).when(left + crop > width, width - crop).otherwise(left)
    return _plan(kind, F.greatest(F.lit(0), moved), 0, F.least(F.lit(width), moved + crop), height)


def crop_one(faces: Column, width: int, height: int, aspect: float) -> Column:
    crop = int(height / aspect)
    return _window("single", F.floor((faces[0]["x1"] + faces[0]["x2"]) / 2).cast("int") - crop // 2, crop, width, height)


def upright_fits(faces: Column, height: int, aspect: float, tolerance: float = 0.9) -> Column:
    """Whether two faces span between tolerance and all of the window's width."""
    spread = F.array_max(F.transform(faces, lambda f: f["x2"])) - F.array_min(F.transform(faces, lambda f: f["x1"]))
    return (spread / F.lit(height / aspect)).between(tolerance, 1.0)


def _mean(faces: Column, low: str, high: str) -> Column:
    return F.aggregate(faces, F.lit(0.0), lambda a, f: a + (f[low] + f[high]) / 2) / F.size(faces)


def crop_upright(faces: Column, width: int, height: int, aspect: float) -> Column:
    crop = int(height / aspect)
    return _window("upright", (_mean(faces, "x1", "x2") - crop / 2).cast("int"), crop, width, height)


def crop_turned(faces: Column, width: int, height: int, aspect: float, spread: bool, max_angle: float = 30.0) -> Column:
    """Turn the frame about the mean of the centres so that the faces stand upright, scaled to hold them all.

    The direction runs from the first to the second centre; with spread, it is
    that of the ranges of the centres. The centre of the turn stays in place, so
    the window follows in closed form. Boxes without extent have no plan.
    """
    kind, crop = ("turned3" if spread else "turned2"), int(height / aspect)
    centre = {k: F.transform(faces, _middle(k)) for k in "xy"}
    run = {k: F.array_max(c) - F.array_min(c) if spread else c[1] - c[0] for k, c in centre.items()}
    angle = F.greatest(F.lit(-max_angle), F.least(F.lit(max_angle), F.degrees(F.atan2(run["y"], run["x"])) - 90))

    def turned(m: Column) -> Column:
        cos, sin = F.cos(F.radians(m["angle"])), F.sin(F.radians(m["angle"]))
        return let(F.struct(cos.alias("c"), sin.alias("s")), lambda t: scaled(m, t))

    def scaled(m: Column, t: Column) -> Column:
        def extent(along: Column, across: Column) -> Column:
            corners = F.flatten(F.transform(faces, lambda f: F.array(*[
                along * (f[x] - m["x"]) + across * (f[y] - m["y"]) for x in ("x1", "x2") for y in ("y1", "y2")
            ])))
            return let(corners, lambda c: F.array_max(c) - F.array_min(c))

        need = F.greatest(extent(t["c"], t["s"]) / F.lit(height / aspect), extent(-t["s"], t["c"]) / F.lit(float(height)))
        return let(need, lambda n: F.when(n > 0, placed(m, n)))

    def placed(m: Column, need: Column) -> Column:
        left = F.greatest(F.lit(0), F.least(F.lit(width - crop), (m["x"] - crop / 2).cast("int")))
        return _plan(kind, left, 0, left + crop, height, m["angle"], F.lit(1.0) / need)

    return let(F.struct(_mean(faces, "x1", "x2").alias("x"), _mean(faces, "y1", "y2").alias("y"), angle.alias("angle")), turned)


def letterbox(width: int, height: int, out: tuple[int, int] = (720, 1560)) -> Column:
    """The whole frame scaled into the output, centred: the rectangle it covers there."""
    scale = min(out[0] / width, out[1] / height)
    w, h = int(width * scale), int(height * scale)
    x, y = (out[0] - w) // 2, (out[1] - h) // 2
    return _plan("letterbox", x, y, x + w, y + h, 0.0, scale)


def crop_plan(faces: Column, width: int, height: int, aspect: float = 2.17, out: tuple[int, int] = (720, 1560)) -> Column:
    """The plan for an array of face boxes: one, two or three faces are framed, others are letterboxed."""
    n = F.size(faces)
    two = F.when(upright_fits(faces, height, aspect), crop_upright(faces, width, height, aspect)).otherwise(crop_turned(faces, width, height, aspect, False))
    return (
        F.when(n == 1, crop_one(faces, width, height, aspect)).when(n == 2, two)
        .when(n == 3, crop_turned(faces, width, height, aspect, True)).otherwise(letterbox(width, height, out))
    )
