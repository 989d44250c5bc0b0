"""Closed-form geometry against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shotloom.functions import geometry as G

W, H, A = 1680, 960, 2.17


def plan(boxes):
    """An independent statement of the crop plan."""
    cw = int(H / A)
    if len(boxes) == 1:
        x = (boxes[0][0] + boxes[0][2]) // 2 - cw // 2
        x = max(0, min(W - cw, x))
        return ("single", x, 0, x + cw, H, 0.0, 1.0)
    if len(boxes) in (2, 3):
        cs = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for b in boxes]
        mx, my = (sum(c[i] for c in cs) / len(cs) for i in (0, 1))
        x = max(0, min(W - cw, math.trunc(mx - cw / 2)))
        spread = (max(b[2] for b in boxes) - min(b[0] for b in boxes)) / (H / A)
        if len(boxes) == 2 and 0.9 <= spread <= 1:
            return ("upright", x, 0, x + cw, H, 0.0, 1.0)
        if len(boxes) == 2:
            dx, dy = cs[1][0] - cs[0][0], cs[1][1] - cs[0][1]
        else:
            dx, dy = (max(c[i] for c in cs) - min(c[i] for c in cs) for i in (0, 1))
        ang = max(-30, min(30, math.degrees(math.atan2(dy, dx)) - 90))
        t = math.radians(ang)
        pts = [(px - mx, py - my) for b in boxes for px in (b[0], b[2]) for py in (b[1], b[3])]
        us = [math.cos(t) * p + math.sin(t) * q for p, q in pts]
        vs = [-math.sin(t) * p + math.cos(t) * q for p, q in pts]
        need = max((max(us) - min(us)) / (H / A), (max(vs) - min(vs)) / H)
        return (f"turned{len(boxes)}", x, 0, x + cw, H, ang, 1 / need) if need else None
    return ("letterbox", 0, 574, 720, 985, 0.0, 720 / 1680)


def test_crop_plans(spark):
    rng = random.Random(2)
    cases = [[]]
    for i in range(300):
        n = rng.choice([1, 2, 2, 2, 3, 4])
        cases.append([(x, y, x + rng.randint(1, 300), y + rng.randint(1, 300)) for x, y in ((rng.randint(0, 1400), rng.randint(0, 700)) for _ in range(n))])
    cases += [[(100, 100, 200, 200), (430, 100, 530, 200)], [(5, 5, 5, 5), (5, 5, 5, 5)]]
    df = spark.createDataFrame([(i, [dict(zip(G.SIDES, b)) for b in c]) for i, c in enumerate(cases)], "i int, faces array<struct<x1:int,y1:int,x2:int,y2:int>>")
    for r in df.select("i", G.crop_plan(F.col("faces"), W, H, A).alias("p")).collect():
        want = plan(cases[r["i"]])
        assert (r["p"] is None) == (want is None)
        if want:
            assert tuple(r["p"])[:5] == want[:5] and tuple(r["p"])[5:] == pytest.approx(want[5:], abs=1e-9), (cases[r["i"]], r["p"], want)


def test_iou_and_boxes(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 0, 15, 10), (0, 0, 0, 0, 0, 0, 0, 0), (0, 0, 4, 4, 8, 8, 9, 9)], "ax1 int, ay1 int, ax2 int, ay2 int, bx1 int, by1 int, bx2 int, by2 int")
    assert [r[0] for r in df.select(G.iou(G.box("a"), G.box("b"))).collect()] == [pytest.approx(1 / 3), 0.0, 0.0]
    row = df.limit(1).select(*[c.alias(n) for n, c in G.normalized(G.box("a"), 20, 40).items()]).head()
    assert tuple(row) == (25.0, 12.5, 50.0, 25.0)
    back = spark.createDataFrame([(25.0, 12.5, 50.0, 25.0)], "a double, b double, c double, d double").select(*[c.alias(s) for s, c in zip(G.SIDES, G.denormalized(*map(F.col, "abcd"), 20, 40))]).head()
    assert tuple(back) == (0, 0, 10, 10)
    inside = df.select(G.inside_image(G.box("a"), 10, 10), G.inside_image(G.box("b"), 10, 10)).head()
    assert tuple(inside) == (True, False)


def test_mouth_boxes(spark):
    kind = "p array<struct<x:int,y:int>>"
    marks = [[(0, 0), (1, 1), (40, 52), (35, 50), (55, 55)], [(0, 0), (1, 1), (60, 42), (60, 40), (100, 42)]]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in m],) for m in marks], kind)
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in zip("xywh", G.mouth_box(F.col("p")))]).collect()] == [(30, 45, 30, 15), (55, 35, 50, 12)]
    assert tuple(df.select(*[c.alias(n) for n, c in zip("xy", G.mouth_midpoint(F.col("p")))]).head()) == (45, 52)
    with pytest.raises(Exception, match="landmarks"):
        spark.createDataFrame([([{"x": 1, "y": 1}],)], kind).select(*[c.alias(n) for n, c in zip("xywh", G.mouth_box(F.col("p")))]).collect()
