"""Labels, colours, frame times and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_mark(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("?"))


def identity_label(global_id: Column, local_id: Column) -> Column:
    """G{global}_V{local}; a question mark for null."""
    return F.concat(F.lit("G"), _or_mark(global_id), F.lit("_V"), _or_mark(local_id))


def full_label(shot: Column, track: Column, face: Column, segment: Column, frame: Column) -> Column:
    parts = [F.concat(F.lit(k), _or_mark(c)) for k, c in (("Sh", shot), ("Tr", track), ("Fa", face), ("Seg", segment), ("Fr", frame))]
    return F.concat_ws("_", *parts)


def shot_label(shot: Column, local_id: Column) -> Column:
    return F.concat(F.lit("S"), _or_mark(shot), F.lit("_C"), _or_mark(local_id))


def face_name(local_id: Column) -> Column:
    """face_N; null for null."""
    return F.concat(F.lit("face_"), local_id.cast("string"))


def parse_bgr(text: Column) -> Column:
    """`b,g,r` as three integers from 0 to 255; anything else fails."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int"))
    fine = (F.size(parts) == 3) & F.forall(parts, lambda v: F.coalesce(v.between(0, 255), F.lit(False)))
    return F.when(fine, parts).otherwise(F.raise_error(F.concat(F.lit("not a colour: "), text)).cast("array<int>"))


def source_colour(source: Column, colours: dict[str, tuple[int, int, int]], default=(255, 0, 255)) -> Column:
    """The colour of an observation's source; magenta for others and null."""
    found = None
    for k, v in colours.items():
        value = F.array(*map(F.lit, v))
        found = F.when(source == k, value) if found is None else found.when(source == k, value)
    other = F.array(*map(F.lit, default))
    return other if found is None else found.otherwise(other)


def frame_seconds(frame: Column, fps: Column) -> Column:
    return frame / fps


def seconds_to_pts(seconds: Column, tb_num: Column, tb_den: Column) -> Column:
    """The nearest tick of the time base, ties to even."""
    return F.bround(seconds * tb_den / tb_num, 0).cast("long")


def middle_frame(first: Column, last: Column) -> Column:
    """floor((first + last) / 2), for negative sums too."""
    return F.floor((first + last) / 2).cast("int")


def rounded(x: Column, digits: int) -> Column:
    """x rounded by the double's exact value, ties to even; F.round rounds its decimal form, half up.

    The exact value of a double needs more digits than a decimal has only far
    from the cut; the nearest two results are compared in exact decimals around it.
    """
    scale = 10**digits
    scaled = x.cast("double") * float(scale)
    low = F.floor(scaled)
    # x * scale - low - 1/2 without the rounding of the product: its sign by Dekker's splitting of x
    split = x.cast("double") * 134217729.0
    high = split - (split - x.cast("double"))
    rest = ((high * float(scale) - scaled) + (x.cast("double") - high) * float(scale))
    part = scaled - low.cast("double") - 0.5
    up = (part + rest > 0) | ((part + rest == 0) & (F.pmod(low, F.lit(2)) == 1))
    small = F.abs(scaled) < float(1 << 50)
    return F.when(small, (low + up.cast("long")).cast("double") / float(scale)).otherwise(x.cast("double"))
