"""Whole flows, rendering rows and the streaming segments."""

import json
import os
from collections import Counter

from pyspark.sql import functions as F

from shotloom import cli
from shotloom.operators import render, shots
from shotloom.plans import fixtures, more_queries, pipelines
from shotloom.sources import documents
from shotloom.streaming import tracks as S

SF = "/root/testdata/sf0.001"
OBS = "shot_id long, frame_idx int, obs_ord long, x1 int, y1 int, x2 int, y2 int, embedding array<float>"
A, B = [1.0, 0.0], [0.0, 1.0]


def observations(spark):
    rows = [(1, f, f, 0, 0, 50, 50, A) for f in range(3)] + [(1, f, 10 + f, 200, 0, 250, 50, B) for f in range(2)]
    rows += [(1, 8, 20, 0, 0, 50, 50, A), (2, 0, 30, 0, 0, 50, 50, B), (2, 5, 31, 0, 0, 50, 50, None)]
    return spark.createDataFrame(rows, OBS)


def test_identities(spark):
    got = {(r["shot_id"], r["track_id"]): (r["local_id"], r["global_id"]) for r in pipelines.resolve_identities(observations(spark)).collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (1, 1), (1, 2): (0, 0), (2, 0): (0, 1), (2, 1): (1, 2)}


def test_identities_by_reference(spark, monkeypatch):
    """Vectors apart from the observations give the same ids, held by the workers or not: repeated, null, zero and unknown ones."""
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.0]), (6, [-0.5, 0.1])]
    rows = [(s, f, 100 * s + 10 * f + k, 300 * k, 0, 300 * k + 50, 50, (s * 7 + f * 3 + k * (f // 2)) % 9) for s in range(12) for f in range(9) for k in range(3) if (s + f * k) % 4]
    o = spark.createDataFrame([r[:7] + (r[7] if r[7] < 8 else None,) for r in rows], "shot_id long, frame_idx int, obs_ord long, x1 int, y1 int, x2 int, y2 int, ref long")
    v = spark.createDataFrame(vectors, "ref long, embedding array<double>")
    found = lambda **more: sorted(tuple(r) for r in pipelines.resolve_identities(**more).select("shot_id", "track_id", "local_id", "global_id").collect())
    want = found(observations=o.join(v, "ref", "left"))
    assert found(observations=o, vectors=v) == want and len({r[3] for r in want}) > 3
    monkeypatch.setattr(pipelines.identity, "HELD", 8)
    assert found(observations=o, vectors=v) == want


def test_identities_move_no_vectors(spark):
    """What q50 shuffles is a few numbers for each observation, not components of vectors, nor copies of them."""

    def moved():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = moved()
    n = more_queries.q50_identities(spark, SF).count()
    assert n > 500 and moved() - before < 600 * fixtures.observations(spark, SF).count()


def test_shot_features_and_validation(spark):
    f = spark.createDataFrame([(1, i, 0.0 if i < 4 else 99.0) for i in range(9)], "v int, i int, x double")
    faces = spark.createDataFrame([(1, 1, 0, 10, 10, 30, 50)], "v int, frame_idx int, face_ord int, x1 int, y1 int, x2 int, y2 int")
    totals = spark.createDataFrame([(1, 12)], "v int, n_frames int")
    doc = pipelines.shot_features(f, "v", ["i"], "x", totals, faces, 100, 100)
    shots_ = json.loads(doc.head()["document"])["shots"]
    assert [(s["first_frame"], s["last_frame"], s["detected_faces"]["face_count"]) for s in shots_] == [(0, 3, 1), (4, 11, 0)]
    assert shots_[0]["detected_faces"]["face_details"][0]["center_x"] == 20.0
    assert pipelines.validate(doc, "v", totals).count() == 0
    rows = documents.shots(doc, "v")
    frames = spark.range(13).select(F.lit(1).alias("v"), F.col("id").cast("int").alias("frame_idx"))
    marked = {r["frame_idx"]: r["marker"] for r in pipelines.annotated_frames(frames, rows, "v").collect()}
    assert [marked[i] for i in (0, 3, 4, 11, 12)] == [1, -1, 1, -1, None]


def test_crop_plans(spark):
    d = spark.createDataFrame([(1, json.dumps([{"frame": 5, "faces": [{"x": 700, "y": 10, "w": 100, "h": 100}]}, {"frame": 6, "faces": []}]))], "v int, document string")
    frames = spark.createDataFrame([(1, i) for i in (0, 1, 5)], "v int, frame_idx int")
    faces = documents.frame_faces(d, "v")
    kinds = lambda by: {r["frame_idx"]: r["plan"]["kind"] for r in pipelines.crop_plans(faces, frames, "v", 1680, 960, by=by).collect()}
    assert kinds("position") == {0: "single", 1: "letterbox"} and kinds("frame") == {5: "single"}


def test_render_rows(spark):
    o = observations(spark)
    rows = render.draw_commands(o, "shot_id", F.col("obs_ord"), F.lit("tracked")).where("frame_idx = 8").orderBy("kind").collect()
    assert [r["kind"] for r in rows] == ["box", "text"] and rows[1]["text"] == "20" and rows[1]["y1"] == 0 and rows[0]["colour"] == [255, 0, 0]
    drawn = render.drawn_faces(o, ["shot_id", "frame_idx"], 220, 220)
    assert {(r["shot_id"], r["frame_idx"]): (r["n_drawn"], r["n_skipped"]) for r in drawn.collect()}[(1, 0)] == (1, 1)
    assert {r["shot_id"]: r["most"] for r in render.most_faces(drawn, "shot_id", F.col("frame_idx") < 3).collect()} == {1: 1, 2: 1}
    assert render.preview_frames(spark.range(100).withColumnRenamed("id", "frame_idx"), 10.0, 2.0).count() == 5


def test_stream_segments_equal_batch(spark, tmp_path):
    rows = [(v, i, float((i * v * 37) % 90)) for v in (1, 2) for i in range(30)]
    kind = "v int, frame_idx int, x double"
    want = {tuple(r) for r in shots.segments(spark.createDataFrame(rows, kind), "v", ["frame_idx"], "x").collect()}
    rows += [(v, 30, 1e6) for v in (1, 2)] + [(v, 1000, 0.0) for v in (1, 2, 9)]
    for i in range(0, 75, 15):
        part = [r for r in rows if i <= r[1] < i + 15] if i < 60 else [r for r in rows if r[1] == 1000]
        spark.createDataFrame(part[::-1], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")) if part else None
    stream = S.with_event_time(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), start=10**9)
    q = S.stream_segments(stream, "v", "x", delay="20 seconds", start=10**9).writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert {tuple(r) for r in spark.table("segments").collect()} == want


def test_commands(spark, tmp_path):
    observations(spark).write.parquet(str(tmp_path / "obs"))
    assert cli.main(["tracks", str(tmp_path / "obs"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    (tmp_path / "shots.json").write_text(json.dumps({"shots": []}))
    assert cli.main(["validate", str(tmp_path / "shots.json"), str(tmp_path / "faults")]) == 0
    assert spark.read.parquet(str(tmp_path / "faults")).count() == 1


def test_all_embeddings_take_part(spark, tmp_path):
    os.symlink(f"{SF}/events.parquet", tmp_path / "events.parquet")
    spark.createDataFrame([(v, [float(v)]) for v in (5, 7, 1000)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {r["obs_ord"]: [(5.0, 7.0, 1000.0)[r["obs_ord"] // 3 % 3]] for r in fixtures.observations(spark, SF).collect()}
    rows = more_queries.embedded(spark, str(tmp_path)).collect()
    assert {r["obs_ord"]: r["embedding"] for r in rows} == want and len(rows) == len(want)


def test_shot_schedule_against_state_machine(spark):
    faces = Counter((r["shot_id"], r["frame_idx"]) for r in fixtures.observations(spark, SF).collect())
    want = set()
    for shot in {s for s, _ in faces}:
        seen, held = False, 0
        for i in range(fixtures.DAYS):
            found = faces[shot, i]
            if i % 10 and seen and held and i % 7 != 6:
                want.add((shot, i, "tracked", held, False))
                continue
            lost = bool(i % 10 and seen and held)
            want.add((shot, i, "fallback" if lost else "detected", found, lost))
            seen, held = seen or found > 0, found
    got = [tuple(r) for r in more_queries.q53_shot_schedule(spark, SF).select("shot_id", "frame_idx", "action", "n_faces", "closes").collect()]
    assert set(got) == want and len(got) == len(want) and {a for _, _, a, _, _ in got} == {"detected", "tracked", "fallback"}
