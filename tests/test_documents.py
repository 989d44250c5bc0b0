"""JSON documents in and out, validation, schedules, frames, models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.functions import models, text
from shotloom.operators import overlay, schedule, shots
from shotloom.sources import documents as D
from shotloom.sources import frames as R


def docs(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "k int, document string")


def shot(n, a, b, faces=0, **more):
    return {"shot_number": n, "first_frame": a, "last_frame": b, "detected_faces": {"face_count": faces}} | more


GOOD = {"shots": [shot(1, 0, 100), shot(2, 101, 200, detected_graphics={})]}


def test_schema_errors(spark):
    short = {"shots": [{k: v for k, v in shot(1, 0, 9).items() if k != "first_frame"}]}
    graphics = {"shots": [shot(1, 0, 9, detected_graphics={"a": 1})]}
    wrong = {"shots": [shot(0, 0, 9, extra=1), shot(2, "x", 9) | {"detected_faces": {"face_count": 1, "face_details": [{"center_x": 120, "center_y": 1, "face_width": 1}]}}], "more": 1}
    found = {}
    for r in shots.schema_errors(docs(spark, GOOD, short, graphics, {"shots": []}, wrong, "no json"), "k").collect():
        found.setdefault(r["k"], []).append(r["message"])
    assert 0 not in found and len(found[1]) == 1 and "first_frame" in found[1][0]
    assert len(found[2]) == 1 and "too many properties" in found[2][0]
    assert len(found[3]) == 1 and len(found[4]) == 6 and found[5] == ["$: is not JSON"]


def test_rules_over_documents(spark):
    gap = {"shots": [shot(1, 0, 100), shot(2, 102, 200), shot(4, 201, 210, 2)]}
    s = D.shots(docs(spark, GOOD, gap), "k")
    assert [tuple(r)[:3] for r in shots.contiguity_errors(s, "k", "pos").collect()] == [(1, "contiguity", 2)]
    assert [tuple(r)[:3] for r in shots.number_errors(s, "k", "pos").collect()] == [(1, "number", 4)]
    assert [tuple(r)[:3] for r in shots.face_count_errors(s, "k").collect()] == [(1, "face_count", 4)]
    totals = spark.createDataFrame([(0, 201), (1, 300)], "k int, n_frames int")
    assert [tuple(r)[:3] for r in shots.coverage_errors(s, totals, "k", "pos").collect()] == [(1, "coverage", 4)]
    back = D.shots(D.shots_document(s, "k"), "k")
    assert sorted(map(str, back.collect())) == sorted(map(str, s.collect()))


def test_tracks_documents(spark):
    d = {"tracks": [{"shot_id": 1, "track_id": 0, "face_label": 7, "observations": [
        {"frame_idx": 0, "bbox": [1, 2, 3, 4]}, {"frame_idx": 1, "bbox": [1, 2, 3, 5], "confidence": None, "embedding": [0.5, 1.5]}]}]}
    rows = D.tracks(docs(spark, d), "k").orderBy("pos").collect()
    assert [r["confidence"] for r in rows] == [1.0, None] and rows[1]["embedding"] == [0.5, 1.5] and rows[0]["face_label"] == 7
    again = D.tracks(D.tracks_document(D.tracks(docs(spark, d), "k"), "k", embeddings=True), "k").orderBy("pos").collect()
    assert [r["bbox"] for r in again] == [r["bbox"] for r in rows] and again[1]["embedding"] == [0.5, 1.5]
    for bad in ({"tracks": [{"track_id": 0, "observations": [{"frame_idx": 0, "bbox": [1, 2, 3, 4]}]}]}, {"tracks": [{"shot_id": 1, "track_id": 0, "observations": [{"frame_idx": 0, "bbox": [10, 20, 30]}]}]}, {"tracks": [{"shot_id": 1, "track_id": 0, "observations": [{"frame_idx": 0, "bbox": [10, "x", 30, 40]}]}]}):
        with pytest.raises(Exception):
            D.tracks(docs(spark, bad), "k").collect()


def test_frame_faces(spark):
    faces = [{"x": 1, "y": 2, "w": 3, "h": 4, "conf": 0.98765, "source": "detected"}]
    entries = [{"frame": 0, "faces": faces}, {"frame": 1, "faces": []}]
    rows = D.frame_faces(docs(spark, entries, {"frames": entries}), "k").orderBy("k", "pos").collect()
    assert [(r["k"], r["frame"], len(r["faces"])) for r in rows] == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0)]
    with pytest.raises(Exception, match="object"):
        D.frame_faces(docs(spark, [1]), "k").collect()
    flat = spark.createDataFrame([(0, 0, 0, 1, 2, 3, 4, 0.98765, "detected")], "k int, frame_idx int, face_ord int, x int, y int, w int, h int, conf double, source string")
    every = spark.createDataFrame([(0, 0), (0, 1)], "k int, frame_idx int")
    assert json.loads(D.frame_faces_document(flat, every, "k").head()["document"]) == [{"frame": 0, "faces": [faces[0] | {"conf": 0.988}]}, {"frame": 1, "faces": []}]


def test_maps(spark):
    t = spark.createDataFrame([(1, 0, 5), (1, 1, None), (2, 0, None)], "shot_id int, track_id int, local_id int")
    assert {r["shot_id"]: r["ids"] for r in D.local_id_map(t).collect()} == {1: {0: "face_5"}, 2: {}}
    nested = {"1": {"0": {"7": [1.0, 1.0]}, "1": {"7": [3.0, 3.0]}}, "2": {}}
    rows = D.embeddings(docs(spark, nested), "k")
    assert rows.count() == 3 and json.loads(D.embeddings_document(rows, "k").head()["document"]) == nested


def test_schedules(spark):
    rows = [(1, 0, 0, True), (1, 1, 2, True), (1, 2, 2, True), (1, 3, 2, False), (1, 4, 1, True), (1, 5, 1, True)]
    df = spark.createDataFrame(rows, "shot_id long, frame_idx int, detected int, tracked_ok boolean")
    got = [(r["action"], r["n_faces"], r["closes"]) for r in schedule.shot_schedule(df, 5).orderBy("frame_idx").collect()]
    assert got == [("detected", 0, False), ("detected", 2, False), ("tracked", 2, False), ("fallback", 2, True), ("tracked", 2, False), ("detected", 1, False)]
    golden = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 0)], "shot_id long, frame_idx int, detected int, tracked_ok int")
    assert [r["action"] for r in schedule.frame_face_schedule(golden, 2).orderBy("frame_idx").collect()] == ["detected", "tracked", "detected", "fallback"]


def test_frames(spark):
    R.register(spark)
    v = spark.read.format("shotloom_video").option("pixels", "true").option("width", "32").option("height", "18").load()
    assert v.count() == 90 and len(v.head()["img"]) == 32 * 18 * 3
    assert R.range_scan(v, 30, 60).count() == 31 and R.range_scan(v, 5, 4).count() == 0
    assert sum(R.range_scan(v, *x).count() for x in ((0, 2), (3, 7))) == 8
    timed = spark.createDataFrame([(i, i * 512, i / 25) for i in range(100)], "frame_idx int, pts long, time_sec double")
    for df in (timed, timed.withColumn("pts", F.lit(None).cast("long"))):
        got = [r[0] for r in R.timed_scan(df, 30, 60, 25.0, 1, 12800, "frame_idx").select("frame_idx").collect()]
        assert got == list(range(30, 61))
    blind = timed.select("frame_idx", F.lit(None).cast("long").alias("pts"), F.lit(None).cast("double").alias("time_sec")).where("frame_idx >= 25")
    assert [r[0] for r in R.timed_scan(blind, 30, 32, 25.0, 1, 12800, "frame_idx").select("frame_idx").collect()] == [30, 31, 32]


def test_segments_scenes_and_overlays(spark):
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 10.0, 50.0, 55.0, 5.0])], "v int, i int, x double")
    assert [tuple(r) for r in shots.segments(f, "v", ["i"], "x").orderBy("shot_number").collect()] == [(1, 1, 0, 1, 2), (1, 2, 2, 3, 2), (1, 3, 4, 4, 1)]
    s = shots.from_scenes(spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 21)], "v int, number int, start int, stop int"), "v", 30).orderBy("shot_number").collect()
    assert [(r["first_frame"], r["last_frame"], r["mid_frame"]) for r in s] == [(0, 9, 4), (10, 29, 15)]
    d = spark.createDataFrame([(1, ["a", "b", "c"], [1, 2])], "k int, p array<string>, q array<int>")
    assert overlay.by_position(d, spark.createDataFrame([(1, 0), (1, 1)], "k int, frame_idx int"), "k", "p").count() == 2
    assert len(d.select(overlay.zipped("p", "q")).head()[0]) == 2


def test_text(spark):
    df = spark.createDataFrame([("1,2,3",)], "c string")
    assert df.select(text.parse_bgr(F.col("c"))).head()[0] == [1, 2, 3]
    for bad in ("1,2", "1,2,300", "a,b,c"):
        with pytest.raises(Exception, match="colour"):
            spark.createDataFrame([(bad,)], "c string").select(text.parse_bgr(F.col("c"))).collect()
    rng = np.random.default_rng(3)
    numbers = [1.005, 2.675, 0.125, 0.375, -0.125, -1.005, 1e300, 0.0, *(rng.integers(-10**6, 10**6, 2000) / 2000).tolist(), *rng.normal(size=2000).tolist()]
    rounded = spark.createDataFrame([(x,) for x in [*numbers, None]], "x double").select("x", text.rounded(F.col("x"), 2), text.rounded(F.col("x"), 3)).collect()
    assert all((r[1], r[2]) == (None, None) if r[0] is None else (r[1], r[2]) == (round(r[0], 2), round(r[0], 3)) for r in rounded)
    assert spark.range(1).select(text.middle_frame(F.lit(-3), F.lit(-4))).head()[0] == -4


def test_models(spark):
    R.register(spark)
    v = spark.read.format("shotloom_video").option("pixels", "true").option("width", "16").option("height", "8").option("seconds", "0.2").load()
    frames = v.select(F.lit(1).cast("long").alias("key"), "frame_idx", "w", "h", "img")

    def detector():
        def run(img):
            if int(img[0, 0, 2]) != 200:
                raise RuntimeError("no")
            return [(1.7, 2, 3, 4), (0, 0, 1, 1)], [[(0, 0)] * 5], [0.9]

        return run

    rows = models.detect(frames, detector).orderBy("frame_idx").collect()
    assert [r["error"] is None for r in rows] == [True] * 3 + [False] * 3 and rows[0]["x1"] == 1
    crops = spark.createDataFrame([(1, 112, 112, bytes(112 * 112 * 3)), (2, 112, 112, bytes([1]) * (112 * 112 * 3))], "id long, w int, h int, img binary")
    found = models.embed(crops, lambda: lambda x: x.reshape(len(x), -1)[:, :4].astype(float), length=4).orderBy("id").collect()
    assert found[0]["embedding"] == [0.0] * 4 and found[1]["embedding"] == [0.5] * 4
    m = models.similarity_transform(models.TEMPLATE * 2 + 5)
    assert np.allclose(m, [[0.5, 0, -2.5], [0, 0.5, -2.5]])
    img = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (models.warp(img, np.array([[1.0, 0, 0], [0, 1, 0]]), (4, 4)) == img).all()
    with pytest.raises(ValueError):
        models.similarity_transform(np.zeros((4, 2)))
