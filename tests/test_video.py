"""Containers, trackers, timers and commands over them."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shotloom import cli
from shotloom.functions import models
from shotloom.operators import render, shots, trackers
from shotloom.plans import pipelines
from shotloom.plans.timers import Timers
from shotloom.sources import frames as R
from shotloom.sources import video

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def stream(n, w=6, h=4, fps="25:1", chroma="C444", tail=b""):
    size = w * h * 3 if chroma == "C444" else w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2)
    planes = [bytes([16 + i]) * (w * h) + bytes([128]) * (size - w * h) for i in range(n)]
    return f"YUV4MPEG2 W{w} H{h} F{fps} {chroma}\n".encode() + b"".join(b"FRAME\n" + p for p in planes) + tail


class Odd(video.Y4M):
    """Stamps that miss, and no seek."""

    mode = "pts"

    def seek(self, seconds):
        raise OSError("no seek")

    def __iter__(self):
        for pts, seconds, image in super().__iter__():
            yield (pts if self.mode == "pts" else None, None if self.mode == "count" else seconds, image)


class Timed(Odd):
    mode = "time"


class Counted(Odd):
    mode = "count"


def test_containers(spark, tmp_path):
    (tmp_path / "a.y4m").write_bytes(stream(12))
    (tmp_path / "b.y4m").write_bytes(stream(3, 5, 3, "30000:1001", "C420", b"FRAME\ncut"))
    (tmp_path / "c.y4m").write_bytes(b"no video")
    files = video.files(spark, str(tmp_path))
    info = {r["path"][-5]: (r["fps"], r["w"], r["h"], r["n_frames"], r["error"]) for r in video.video_info(files).collect()}
    assert info["a"] == (25.0, 6, 4, 12, None) and info["b"][3] == 3 and info["b"][0] == pytest.approx(29.97, abs=1e-3) and "not a YUV" in info["c"][4]
    good = files.where("path not like '%c.y4m'")
    for factory in (video.y4m, lambda: Odd, lambda: Timed, lambda: Counted):
        got = video.read_frames(good, 2, 7, factory=factory).collect()
        by = {(r["path"][-5], r["frame_idx"]): r for r in got}
        assert sorted(by) == [("a", i) for i in range(2, 8)] + [("b", 2)] and len(got) == 7
        assert all(np.frombuffer(r["img"], np.uint8).tolist() == [16 + i] * (r["w"] * r["h"] * 3) for (_, i), r in by.items())
    assert video.read_frames(good, 5, 4).count() == 0 and video.read_frames(good, pixels=False).count() == 15
    assert video.read_frames(good, 100).count() == 0


def test_written_containers(spark):
    R.register(spark)
    v = spark.read.format("shotloom_video").options(pixels="true", seconds="0.5", width="16", height="8").load().withColumn("path", F.lit("x"))
    back = video.read_frames(video.written_y4m(v, "path", "frame_idx", 30)).collect()
    want = {r["frame_idx"]: np.frombuffer(r["img"], np.uint8).astype(int) for r in v.collect()}
    assert len(back) == 15 and all(np.abs(np.frombuffer(r["img"], np.uint8) - want[r["frame_idx"]]).max() <= 2 for r in back)


def moving(spark, n=9, size=40):
    """A bright square that moves two pixels a frame, gone in frame 5 of the second shot."""
    rows = []
    for shot in (1, 2):
        for i in range(n):
            image = np.zeros((size, size, 3), np.uint8)
            if (shot, i) != (2, 5):
                image[10:18, 2 + 2 * i : 10 + 2 * i] = 250
            rows.append((shot, i, size, size, image.tobytes()))
    return spark.createDataFrame(rows, "shot_id long, frame_idx int, w int, h int, img binary")


def brightest():
    def detect(image):
        y, x = np.nonzero(image[:, :, 0] > 200)
        return [(x.min(), y.min(), x.max() + 1, y.max() + 1)] if len(x) else []

    return detect


def test_trackers(spark):
    rows = {(r["shot_id"], r["frame_idx"]): r for r in trackers.track(moving(spark), brightest, lambda: trackers.Template, 7).collect()}
    assert all(rows[1, i]["x1"] == 2 + 2 * i and rows[1, i]["x2"] == 10 + 2 * i for i in range(9))
    assert [rows[1, i]["action"] for i in range(9)] == ["detected" if i % 7 == 0 else "tracked" for i in range(9)]
    assert [rows[2, i]["action"] for i in (4, 5, 6, 7, 8)] == ["tracked", "fallback", "detected", "detected", "tracked"]
    assert rows[2, 5]["track_id"] is None and [rows[2, i]["track_id"] for i in (4, 6, 7, 8)] == [0, 1, 2, 2]


def test_flow(spark):
    def follow():
        return lambda before, now, points: (points + [2, 0], points[:, 0] < 10)

    points = spark.createDataFrame([(1, 0, 3.0, 12.0), (1, 1, 30.0, 5.0)], "shot_id long, point int, x double, y double")
    got = {(r["frame_idx"], r["point"]): (r["x"], r["found"]) for r in trackers.flow(moving(spark).where("shot_id = 1"), points, follow).collect()}
    assert [got[i, 0] for i in range(6)] == [(3, True), (5, True), (7, True), (9, True), (11, True), (11, False)] and got[3, 1] == (30, False)
    assert trackers.flow(moving(spark).where("shot_id = 2"), points, follow).count() == 0


def test_crops(spark):
    f = moving(spark).where("shot_id = 1 and frame_idx < 2").select(F.col("frame_idx").cast("long").alias("id"), "w", "h", "img")
    got = {r["id"]: r for r in models.cropped(f.selectExpr("*", "int(id * 60 - 5) as x1", "10 as y1", "int(id * 60 + 6) as x2", "18 as y2")).collect()}
    assert (got[0]["w"], got[0]["h"], got[0]["error"]) == (6, 8, None) and np.frombuffer(got[0]["img"], np.uint8).reshape(8, 6, 3)[0, :, 0].tolist() == [0, 0] + [250] * 4
    assert got[1]["img"] is None and "outside" in got[1]["error"]
    marks = F.array(*[F.struct(F.lit(x / 4).alias("x"), F.lit(y / 4).alias("y")) for x, y in models.TEMPLATE.tolist()])
    one = models.aligned(f.where("id = 0").withColumn("landmarks", marks)).head()
    assert (one["w"], one["h"], one["error"]) == (112, 112, None)
    picture = np.frombuffer(one["img"], np.uint8).reshape(112, 112, 3)
    assert picture[56, 20, 0] == 250 and picture[56, 60, 0] == 0  # four times as large
    assert "five" in models.aligned(f.where("id = 0").withColumn("landmarks", F.slice(marks, 1, 3))).head()["error"]


def test_timers(spark):
    t = Timers()
    with t("read"):
        pass
    with pytest.raises(ValueError), t("read"):
        raise ValueError
    assert t.run("write", spark.range(5)).count() == 5
    got = {r["stage"]: (r["calls"], r["seconds"]) for r in t.rows(spark).collect()}
    assert got["read"][0] == 2 and got["write"][1] > 0 and list(t.seconds) == ["read", "write"]


def test_schema_from_a_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 3}, "list": {"type": "array", "minItems": 2, "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "string"}}}}, "in": {"type": "object", "required": ["y"]}}}))
    rules = shots.load_schema(spark, str(tmp_path / "s.json"))
    docs = spark.createDataFrame([(0, '{"a":1}'), (1, '{"a":7,"list":[{"x":1}],"in":{}}'), (2, '{"list":[{},{"x":"y"}]}'), (3, "[]")], "k int, document string")
    got = {}
    for r in shots.schema_errors(docs, "k", schema=rules).collect():
        got.setdefault(r["k"], set()).add((r["shot_number"], r["message"]))
    assert got == {
        1: {(None, "$.a: is greater than the maximum of 3"), (None, "$.list: has fewer than 2 items"), (1, "$.list.x: is not of type 'string'"), (None, "$.in: 'y' is a required property")},
        2: {(None, "$: 'a' is a required property"), (1, "$.list: 'x' is a required property")}, 3: {(None, "$: is not of type 'object'")},
    }


def test_feature_and_drawing_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    at = lambda n: str(tmp_path / n)
    rows = [("v", i, 0.0 if i < 4 else 99.0) for i in range(9)]
    spark.createDataFrame(rows, "path string, frame_idx int, feature double").write.parquet(at("features"))
    spark.createDataFrame([("v", 1, 0, 10, 10, 30, 50)], "path string, frame_idx int, face_ord int, x1 int, y1 int, x2 int, y2 int").write.parquet(at("faces"))
    assert cli.main(["features", at("features"), at("docs"), "--faces", at("faces"), "--size", "100", "100"]) == 0
    doc = spark.read.parquet(at("docs")).head()["document"]
    assert [s["detected_faces"]["face_count"] for s in json.loads(doc)["shots"]] == [1, 0]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "d.json").write_text(doc)
    path = spark.read.text(at("json")).select(F.input_file_name()).head()[0]
    spark.createDataFrame([(path, i) for i in range(10)], "path string, frame_idx int").write.parquet(at("frames"))
    assert cli.main(["visualize", at("json"), at("drawn"), "--frames", at("frames"), "--size", "100", "100"]) == 0
    got = spark.read.parquet(at("drawn")).collect()
    labels = {r["frame_idx"]: r["text"] for r in got if r["kind"] == "text" and r["text"]}
    assert labels[0] == "shot 1 start" and labels[3] == "shot 1 end" and labels[5] == "shot 2" and 9 not in labels
    assert {(r["x1"], r["y1"], r["x2"], r["y2"]) for r in got if r["kind"] == "box"} == {(10, 10, 30, 50)} and sum(r["kind"] == "box" for r in got) == 4


def test_mouths(spark):
    marks = [{"x": 1.0, "y": 1.0}] * 2 + [{"x": float(x), "y": 20.0} for x in (10, 20, 15)]
    df = spark.createDataFrame([("k", 0, marks), ("k", 1, marks[:4])], "key string, frame_idx int, landmarks array<struct<x:double,y:double>>")
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in render.mouth_commands(df, "key").collect()] == [(5, 15, 25, 25)]
    assert pipelines.shot_drawing.__doc__
