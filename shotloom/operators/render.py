"""Draw commands as rows: what a renderer puts on each frame. Encoders and windows are sinks outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SIDES, inside_image, mouth_box
from ..functions.text import source_colour

#: Box colours by the source of an observation, blue-green-red.
COLOURS = {"detected": (0, 255, 0), "tracked": (255, 0, 0), "fallback": (0, 165, 255)}

#: Colours of the first and last frame of a shot, and of mouths.
MARKED, MOUTH = (0, 0, 255), (255, 255, 0)


def draw_commands(observations: DataFrame, key: str, label: Column, source: Column | None = None, margin: int = 10) -> DataFrame:
    """(key, frame_idx, kind, x1, y1, x2, y2, colour, text): a box and the text above it for each observation.

    The text stays inside the image at the top. Without a source, boxes are green.
    """
    colour = F.array(*map(F.lit, COLOURS["detected"])) if source is None else source_colour(source, COLOURS)
    text_y = F.greatest(F.col("y1") - margin, F.lit(0))
    shapes = F.array(
        F.struct(F.lit("box").alias("kind"), *[F.col(s) for s in SIDES], colour.alias("colour"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("text").alias("kind"), F.col("x1"), text_y.alias("y1"), F.col("x1").alias("x2"), text_y.alias("y2"), colour.alias("colour"), label.cast("string").alias("text")),
    )
    return observations.select(key, "frame_idx", F.explode(shapes).alias("_s")).select(key, "frame_idx", "_s.*")


def shot_labels(annotated: DataFrame, key: str) -> DataFrame:
    """(key, frame_idx, kind, x1, y1, x2, y2, colour, text): the shot's number on each of its frames, marked at its first and last.

    annotated has shot_number and marker (1, -1 or 0); frames outside all shots have no row.
    """
    mark = F.when(F.col("marker") == 1, " start").when(F.col("marker") == -1, " end").otherwise("")
    colour = F.when(F.col("marker") != 0, F.array(*map(F.lit, MARKED))).otherwise(F.array(*map(F.lit, COLOURS["detected"])))
    at = [F.lit(v).alias(s) for v, s in zip((10, 30, 10, 30), SIDES)]
    text = F.concat(F.lit("shot "), F.col("shot_number").cast("string"), mark)
    return annotated.where("shot_number is not null").select(key, "frame_idx", F.lit("text").alias("kind"), *at, colour.alias("colour"), text.alias("text"))


def mouth_commands(faces: DataFrame, key: str) -> DataFrame:
    """(key, frame_idx, kind, x1, y1, x2, y2, colour, text): a box around the mouth of each face with five landmarks or more."""
    x, y, w, h = mouth_box(F.col("landmarks"))
    rows = faces.where(F.size("landmarks") >= 5)
    return rows.select(key, "frame_idx", F.lit("box").alias("kind"), x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + w).cast("int").alias("x2"), (y + h).cast("int").alias("y2"), F.array(*map(F.lit, MOUTH)).alias("colour"), F.lit(None).cast("string").alias("text"))


def drawn_faces(boxes: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, n_drawn, n_skipped): boxes inside the image are drawn, others skipped."""
    fine = inside_image(tuple(map(F.col, SIDES)), width, height)
    return boxes.groupBy(*keys).agg(F.count_if(fine).alias("n_drawn"), F.count_if(~fine).alias("n_skipped"))


def most_faces(drawn: DataFrame, key: str, detected: Column) -> DataFrame:
    """(key, most): the largest number of faces drawn in a frame that was detected; 0 if none was."""
    return drawn.groupBy(key).agg(F.coalesce(F.max(F.when(detected, F.col("n_drawn"))), F.lit(0)).alias("most"))


def preview_frames(frames: DataFrame, fps: Column | float, seconds: float) -> DataFrame:
    """Every (fps * seconds)-th frame, from the first on."""
    step = F.greatest(F.lit(1), (F.lit(fps) * seconds).cast("int") if not isinstance(fps, Column) else (fps * seconds).cast("int"))
    return frames.where(F.pmod(F.col("frame_idx"), step) == 0)


def render_end(total: Column, last_overlay: Column) -> Column:
    """One past the last frame to render: that of the video, or of its overlays if they go further."""
    return F.greatest(total, F.coalesce(last_overlay, F.lit(0)) + 1)
