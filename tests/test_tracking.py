"""Linking against hand-made cases and an independent model."""

import random

import pytest
from pyspark.sql import functions as F

from shotloom.operators import tracking

OBS = "shot_id long, frame_idx int, obs_ord long, x1 int, y1 int, x2 int, y2 int"


def link(spark, rows, **kw):
    df = spark.createDataFrame([(s, f, i, *b) for i, (s, f, b) in enumerate(rows)], OBS)
    return {(r["shot_id"], r["obs_ord"]): r["track_id"] for r in tracking.link_tracks(df, **kw).collect()}


CASES = [
    ([(0, (10, 10, 50, 50))], [0]),
    ([(0, (10, 10, 50, 50)), (1, (11, 11, 51, 51))], [0, 0]),
    ([(0, (10, 10, 50, 50)), (1, (200, 200, 250, 250))], [0, 1]),
    ([(0, (10, 10, 50, 50)), (0, (100, 100, 140, 140))], [0, 1]),
    ([(0, (10, 10, 50, 50)), (1, (11, 11, 51, 51)), (1, (100, 100, 140, 140))], [0, 0, 1]),
    ([(0, (0, 0, 10, 10)), (1, (0, 0, 10, 10)), (2, (100, 100, 110, 110)), (3, (0, 0, 10, 10)), (3, (100, 100, 110, 110))], [0, 0, 1, 2, 1]),
    ([(0, (10, 10, 50, 50)), (1, (40, 40, 80, 80))], [0, 1]),
    ([(0, (10, 10, 50, 50)), (2, (10, 10, 50, 50))], [0, 1]),
]


def test_cases(spark):
    rows = [(k, f, b) for k, (case, _) in enumerate(CASES) for f, b in case]
    got = link(spark, rows)
    assert [got[k] for k in sorted(got)] == [t for _, want in CASES for t in want]


def test_processed_frames_decide_what_closes(spark):
    rows = [(1, 0, (0, 0, 10, 10)), (1, 10, (0, 0, 10, 10))]
    frames = spark.createDataFrame([(1, 0), (1, 10)], "shot_id long, frame_idx int")
    assert set(link(spark, rows, frames=frames).values()) == {0}
    frames = spark.createDataFrame([(1, 0), (1, 5), (1, 10)], "shot_id long, frame_idx int")
    assert set(link(spark, rows, frames=frames).values()) == {0, 1}


def test_conflict_policy(spark):
    rows = [(1, 0, (0, 0, 10, 10)), (1, 1, (0, 0, 10, 10)), (1, 1, (0, 0, 10, 9))]
    with pytest.raises(Exception, match="two observations"):
        link(spark, rows)
    assert link(spark, rows, conflict="first_wins") == {(1, 0): 0, (1, 1): 0, (1, 2): 1}


def model(rows, threshold):
    """First-wins linking, written apart: a list of [last box, last frame, id]."""
    out, alive, n = [], [], 0
    for f in sorted({r[0] for r in rows}):
        alive = [a for a in alive if a[1] == f - 1]
        fresh = []
        for i, (g, b) in enumerate(rows):
            if g != f:
                continue
            scored = []
            for a in alive:
                if a[1] == f:
                    continue
                w = max(0, min(a[0][2], b[2]) - max(a[0][0], b[0])) * max(0, min(a[0][3], b[3]) - max(a[0][1], b[1]))
                u = (a[0][2] - a[0][0]) * (a[0][3] - a[0][1]) + (b[2] - b[0]) * (b[3] - b[1]) - w
                if u and w / u >= threshold and w:
                    scored.append((-w / u, a[2], a))
            if scored:
                a = min(scored)[2]
                a[0], a[1] = b, f
                out.append((i, a[2]))
            else:
                fresh.append((i, b))
        for i, b in fresh:
            alive.append([b, f, n])
            out.append((i, n))
            n += 1
    return [t for _, t in sorted(out)]


def test_against_model_with_competing_boxes(spark):
    rng = random.Random(5)
    shots, want = [], []
    for s in range(60):
        rows = []
        for f in range(8):
            for _ in range(rng.randint(0, 4)):
                x, y = rng.randint(0, 12), rng.randint(0, 12)
                rows.append((f, (x, y, x + rng.randint(8, 20), y + rng.randint(8, 20))))
        shots += [(s, f, b) for f, b in rows]
        want += model(rows, 0.4)
    got = link(spark, shots, threshold=0.4, conflict="first_wins")
    assert [got[k] for k in sorted(got, key=lambda k: k[1])] == want


def test_summary_accessors(spark):
    rows = [(1, 0, 5, 0, 0, 10, 10, 3), (1, 1, 9, 10, 10, 20, 20, 3)]
    df = spark.createDataFrame(rows, "shot_id long, obs_ord long, frame_idx int, x1 int, y1 int, x2 int, y2 int, track_id int")
    s = tracking.track_summary(df).head()
    assert (s["duration"], s["mean_x1"], s["mean_y2"], s["first_x1"], s["last_x2"]) == (5, 5.0, 15.0, 0, 20)
    assert tracking.track_frames(df).head()["frames"] == [5, 9]
    assert tracking.box_at(df, 9).head()["box"]["x1"] == 10 and not tracking.box_at(df, 6).count()
    assert tracking.box_number(df, 1).head()["box"]["x1"] == 10
    assert tracking.box_number(df, 2).head()["box"] is None and tracking.box_number(df, -1).head()["box"] is None
    assert not tracking.repeated_frames(df).count() and tracking.repeated_frames(df.union(df)).count() == 2


def test_claims_and_conflicts(spark):
    a = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "g int, track_id int")
    b = spark.createDataFrame([(1, 0, .9), (1, 1, .8)], "g int, item_ord int, s double")
    ranked = tracking.claims(a, b, ["g"], F.col("s") - F.col("track_id") * 0.01, 0.5, F.col("track_id") == 2)
    assert {(r.track_id, r.item_ord) for r in ranked.where("rank = 1").collect()} == {(0, 0), (1, 0)}
    solved = tracking.resolve_claims(ranked, ["g"]).where("assigned").collect()
    assert [(r.track_id, r.item_ord) for r in solved] == [(0, 0)]
