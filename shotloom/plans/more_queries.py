"""Further queries: accessors, validation, documents, rendering rows, sources and plug-in points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import models
from ..functions import text as X
from ..functions import vectors as V
from ..operators import overlay, render, schedule, shots, trackers, tracking
from ..sources import documents, frames, video
from . import pipelines
from .fixtures import FRAMES, HEIGHT, OBSERVATIONS, TRACKS, WIDTH, all_frames, observations, table
from .queries import CLAIMS, SEGMENTS, TURNS, _segments, _tracked, _turns, query, shot_schedule_sql
from ..streaming import tracks as streams
from .scratch import new_path, numbered


@query(CLAIMS + ", twice AS (SELECT shot_id, frame_idx, 2 * track_id + k AS track_id, item_ord FROM ranked, range(2) t(k) WHERE rk = 1) SELECT shot_id, frame_idx, track_id, item_ord, row_number() OVER (PARTITION BY shot_id, frame_idx, item_ord ORDER BY track_id) = 1 AS assigned FROM twice")
def q28_resolved_claims(spark, sf_dir):
    """Every candidate comes twice, so that two compete for each best item: the smaller id gets it, the other loses."""
    o = observations(spark, sf_dir)
    cand = o.select("shot_id", "frame_idx", F.explode(F.array(F.col("obs_ord") * 2, F.col("obs_ord") * 2 + 1)).alias("track_id"), *[F.col(s).alias("c" + s) for s in G.SIDES])
    item = o.select("shot_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("obs_ord").alias("item_ord"), *G.SIDES)
    keys = ["shot_id", "frame_idx"]
    ranked = tracking.claims(cand, item, keys, G.iou(G.box("c"), G.box()), 0.3)
    return tracking.resolve_claims(ranked, keys).where("rank = 1").select(*keys, "track_id", "item_ord", "assigned")


@query(f"""WITH {TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM turns)
SELECT conv_id, 'number' AS rule, shot_number, 'shot_number mismatch at array index ' || (i - 1) || ': expected ' || i || ', got ' || shot_number AS message FROM n WHERE shot_number <> i""")
def q29_number_rule(spark, sf_dir):
    return shots.number_errors(_turns(spark, sf_dir), "conv_id", "turn")


@query("""SELECT conv_id * 1000 + turn AS k, unnest(list_filter([
  CASE WHEN turn % 4 = 1 THEN 'shot: ''first_frame'' is a required property' END, CASE WHEN turn % 4 = 2 THEN 'shot.detected_graphics: has too many properties' END,
  CASE WHEN turn % 4 = 3 THEN 'shot.last_frame: is less than the minimum of 0' END], lambda m: m IS NOT NULL)) AS message FROM conversations""")
def q30_schema_rules(spark, sf_dir):
    """One-shot documents with a fault by turn: a missing field, an object that must be empty, a negative frame."""
    t = F.col("turn") % 4
    first = F.when(t != 1, F.lit('"first_frame":0,')).otherwise("")
    last = F.when(t == 3, "-1").otherwise("9")
    graphics = F.when(t == 2, '{"a":1}').otherwise("{}")
    doc = F.concat(F.lit('{"shots":[{"shot_number":1,'), first, F.lit('"last_frame":'), last, F.lit(',"detected_faces":{"face_count":0},"detected_graphics":'), graphics, F.lit("}]}"))
    d = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), doc.alias("document"))
    return shots.schema_errors(d, "k").select("k", "message")


@query(f"""WITH {SEGMENTS}, l AS (SELECT *, max(shot_number) OVER (PARTITION BY user_id) AS top FROM segments)
SELECT user_id, shot_number, first_frame, CASE WHEN shot_number = top AND last_frame < 99 THEN 99 ELSE last_frame END AS last_frame FROM l""")
def q31_shot_repair(spark, sf_dir):
    s = _segments(spark, sf_dir)
    top = s.groupBy("user_id").agg(F.max("shot_number").alias("top"))
    return shots.repaired(s.join(top, "user_id"), 100, F.col("shot_number") == F.col("top")).select("user_id", "shot_number", "first_frame", "last_frame")


@query("""WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) * (vec_id % 7) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM u GROUP BY vec_id) SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CASE WHEN n = 0 THEN 0.0 ELSE x / n END, 6) AS x FROM u JOIN n USING (vec_id)""")
def q32_l2_normalize(spark, sf_dir):
    """Scaled vectors, every seventh zero."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    e = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    return e.select("vec_id", F.posexplode(V.l2_normalized(F.col("v"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {TRACKS}, n AS (SELECT *, row_number() OVER (PARTITION BY shot_id, track_id ORDER BY frame_idx) AS i FROM tracked)
SELECT shot_id, track_id, 'frame 3' AS what, x1, y1 FROM tracked WHERE frame_idx = 3
UNION ALL SELECT t.shot_id, t.track_id, 'second' AS what, n.x1, n.y1 FROM (SELECT DISTINCT shot_id, track_id FROM tracked) t LEFT JOIN n ON t.shot_id = n.shot_id AND t.track_id = n.track_id AND n.i = 2""")
def q33_track_lookups(spark, sf_dir):
    """A track's box in a frame, and by position."""
    t = _tracked(spark, sf_dir)
    at = tracking.box_at(t, 3).withColumn("what", F.lit("frame 3")).unionByName(tracking.box_number(t, 1).withColumn("what", F.lit("second")))
    return at.select("shot_id", "track_id", "what", "box.x1", "box.y1")


@query(f"""WITH {OBSERVATIONS} SELECT shot_id, frame_idx, 'box' AS kind, x1, y1, x2, y2, CASE obs_ord % 3 WHEN 0 THEN '255,0,0' WHEN 1 THEN '0,165,255' ELSE '255,0,255' END AS colour, CAST(NULL AS VARCHAR) AS text FROM obs
UNION ALL SELECT shot_id, frame_idx, 'text', x1, greatest(0, y1 - 150), x1, greatest(0, y1 - 150), CASE obs_ord % 3 WHEN 0 THEN '255,0,0' WHEN 1 THEN '0,165,255' ELSE '255,0,255' END, CAST(obs_ord AS VARCHAR) FROM obs""")
def q34_draw_commands(spark, sf_dir):
    source = F.when(F.col("obs_ord") % 3 == 0, "tracked").when(F.col("obs_ord") % 3 == 1, "fallback").otherwise("other")
    drawn = render.draw_commands(observations(spark, sf_dir), "shot_id", F.col("obs_ord"), source, margin=150)
    return drawn.withColumn("colour", F.array_join(F.col("colour").cast("array<string>"), ","))


@query(f"""WITH {OBSERVATIONS} SELECT shot_id, frame_idx, count(*) FILTER (fine) AS n_drawn, count(*) FILTER (NOT fine) AS n_skipped FROM (SELECT *, x1 < 1000 AND y1 < 270 AND x2 <= 1000 AND y2 <= 270 AS fine FROM obs) GROUP BY ALL""")
def q35_drawn_faces(spark, sf_dir):
    """Boxes inside an image of 1000 x 270."""
    return render.drawn_faces(observations(spark, sf_dir), ["shot_id", "frame_idx"], 1000, 270)


@query("""SELECT event_id, CAST(event_id % 256 AS INTEGER) AS b, CAST(user_id % 256 AS INTEGER) AS g, 7 AS r,
  CASE event_type WHEN 'click' THEN '0,255,0' WHEN 'view' THEN '255,0,0' ELSE '255,0,255' END AS colour FROM events""")
def q36_colours(spark, sf_dir):
    """Colours parsed from text, and by source with a default."""
    e = table(spark, sf_dir, "events")
    bgr = X.parse_bgr(F.concat_ws(",", F.col("event_id") % 256, F.col("user_id") % 256, F.lit(7)))
    by = X.source_colour(F.col("event_type"), {"click": (0, 255, 0), "view": (255, 0, 0)})
    e = e.select("event_id", bgr.alias("p"), F.array_join(by.cast("array<string>"), ",").alias("colour"))
    return e.select("event_id", *[F.col("p")[i].alias(n) for i, n in enumerate("bgr")], "colour")


@query("""SELECT event_id, CAST(floor((event_id + user_id) / 2) AS INTEGER) AS mid, round(event_id / 30.0::DOUBLE, 9) AS seconds,
  CAST(round_even(event_id / 25.0::DOUBLE * 12800 / 1, 0) AS BIGINT) AS pts FROM events""")
def q37_frame_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seconds = X.frame_seconds(F.col("event_id"), F.lit(25.0))
    return e.select("event_id", X.middle_frame(F.col("event_id"), F.col("user_id")).alias("mid"), F.round(X.frame_seconds(F.col("event_id"), F.lit(30.0)), 9).alias("seconds"), X.seconds_to_pts(seconds, F.lit(1), F.lit(12800)).alias("pts"))


@query(f"""WITH {OBSERVATIONS}, {FRAMES} SELECT f.shot_id, f.frame_idx, count(obs_ord) AS n, CAST(coalesce(sum(x1 + y1 * 2 + (x2 - x1) * 3 + (y2 - y1) * 5), 0) AS BIGINT) AS mark, CAST(coalesce(sum(round(obs_ord % 1000 / 7.0::DOUBLE * 1000)), 0) AS BIGINT) AS thousandths FROM frames f LEFT JOIN obs USING (shot_id, frame_idx) GROUP BY ALL""")
def q38_frame_face_documents(spark, sf_dir):
    """Per-frame face lists written as documents, empty frames too, read again and joined to frames by position."""
    o = observations(spark, sf_dir)
    x, y, w, h = G.to_xywh(G.box())
    faces = o.select("shot_id", "frame_idx", F.col("obs_ord").alias("face_ord"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (F.col("obs_ord") % 1000 / 7.0).alias("conf"), F.lit("detected").alias("source"))
    f = all_frames(spark, sf_dir)
    back = documents.frame_faces(documents.frame_faces_document(faces, f, "shot_id"), "shot_id")
    mark = F.aggregate("faces", F.lit(0).cast("long"), lambda a, b: a + b["x"] + b["y"] * 2 + b["w"] * 3 + b["h"] * 5)
    thousandths = F.aggregate("faces", F.lit(0).cast("long"), lambda a, b: a + F.round(b["conf"] * 1000).cast("long"))
    rows = back.select("shot_id", F.col("pos").alias("frame_idx"), F.size("faces").cast("long").alias("n"), mark.alias("mark"), thousandths.alias("thousandths"))
    return f.join(rows, ["shot_id", "frame_idx"])


@query("""SELECT CAST(label AS VARCHAR) AS shot_id, CAST(vec_id AS VARCHAR) AS track_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings""")
def q39_embedding_documents(spark, sf_dir):
    """Vectors nested by shot, frame and track, written and read again."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("k"), F.col("label").cast("string").alias("shot_id"), (F.col("vec_id") % 5).cast("string").alias("frame_idx"), F.col("vec_id").cast("string").alias("track_id"), "embedding"
    )
    back = documents.embeddings(documents.embeddings_document(rows, "k"), "k")
    return back.select("shot_id", "track_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query(f"""WITH {OBSERVATIONS}, g AS (SELECT shot_id, frame_idx, list(obs_ord ORDER BY obs_ord) AS o, list(x1 ORDER BY obs_ord) AS x FROM obs GROUP BY ALL)
SELECT shot_id, frame_idx, unnest(o[:2]) AS obs_ord, unnest(x[:2]) AS x1 FROM g""")
def q40_positional_zip(spark, sf_dir):
    """Two lists of a frame, the second cut to two entries, zipped to the shorter."""
    f = observations(spark, sf_dir).groupBy("shot_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("obs_ord", "x1"))).alias("a"))
    f = f.select("shot_id", "frame_idx", F.transform("a", lambda s: s["obs_ord"]).alias("o"), F.slice(F.transform("a", lambda s: s["x1"]), 1, 2).alias("x"))
    return f.select("shot_id", "frame_idx", F.explode(overlay.zipped("o", "x")).alias("z")).select("shot_id", "frame_idx", F.col("z.o").alias("obs_ord"), F.col("z.x").alias("x1"))


@query(f"""WITH {TRACKS} SELECT shot_id, track_id, frame_idx, CAST(2 AS BIGINT) AS n FROM tracked WHERE frame_idx % 10 = 0""")
def q41_repeated_frames(spark, sf_dir):
    """Tracks with every tenth frame observed twice."""
    t = _tracked(spark, sf_dir)
    return tracking.repeated_frames(t.unionByName(t.where("frame_idx % 10 = 0")))


@query(f"""WITH {TRACKS} SELECT DISTINCT a.shot_id, a.track_id AS track_a, b.track_id AS track_b FROM tracked a JOIN tracked b ON a.shot_id = b.shot_id AND a.frame_idx = b.frame_idx AND a.track_id < b.track_id""")
def q42_shared_frames(spark, sf_dir):
    """Pairs of tracks whose frame lists meet: candidates by interval, then the lists."""
    t = _tracked(spark, sf_dir)
    lists = tracking.track_frames(t)
    pairs = tracking.overlap_pairs(tracking.tracks(t))
    a, b = (lists.select("shot_id", F.col("track_id").alias(f"track_{s}"), F.col("frames").alias(f"f{s}")) for s in "ab")
    met = pairs.join(a, ["shot_id", "track_a"]).join(b, ["shot_id", "track_b"]).where(F.arrays_overlap("fa", "fb"))
    return met.select("shot_id", "track_a", "track_b")


@query("SELECT CAST(range AS INTEGER) AS frame_idx FROM range(30, 61)")
def q43_timed_scan(spark, sf_dir):
    """The wanted range of the synthetic video by time stamps, from an earlier start."""
    frames.register(spark)
    v = spark.read.format("shotloom_video").load().withColumn("pts", F.col("pts") * 512)
    return frames.timed_scan(v.where("frame_idx >= 20"), 30, 60, 30.0, 1, 15360, "frame_idx", stamped=True).select("frame_idx")


@query(f"""WITH {OBSERVATIONS} SELECT obs_ord, x2 - x1 AS w, y2 - y1 AS h, CAST(trunc(x1 + 0.75) AS INTEGER) AS bx1, CAST(trunc(y1 + (y2 - y1) + 0.5) AS INTEGER) AS by2 FROM obs""")
def q44_box_conversions(spark, sf_dir):
    x, y, w, h = G.to_xywh(G.box())
    back = G.to_xyxy(x + F.lit(0.75), y + F.lit(0.5), w, h)
    return observations(spark, sf_dir).select("obs_ord", w.alias("w"), h.alias("h"), back[0].alias("bx1"), back[3].alias("by2"))


@query(f"WITH {OBSERVATIONS} SELECT shot_id, min(frame_idx) AS first, max(frame_idx) AS last, count(DISTINCT frame_idx) AS n_frames FROM obs GROUP BY shot_id")
def q45_overlay_range(spark, sf_dir):
    return overlay.overlay_range(observations(spark, sf_dir), "shot_id")


@query(f"""WITH {OBSERVATIONS}, {FRAMES}, e AS (SELECT shot_id, greatest(20, max(frame_idx) + 1) AS stop FROM obs GROUP BY shot_id)
SELECT shot_id, frame_idx, stop FROM frames JOIN e USING (shot_id) WHERE frame_idx < stop AND frame_idx % 6 = 0""")
def q46_preview_frames(spark, sf_dir):
    """Every sixth frame up to the end of the video (20 frames) or of its overlays."""
    last = overlay.overlay_range(observations(spark, sf_dir), "shot_id").select("shot_id", render.render_end(F.lit(20), F.col("last")).alias("stop"))
    return render.preview_frames(all_frames(spark, sf_dir).join(last, "shot_id").where("frame_idx < stop"), 3.0, 2.0)


@query("""SELECT CAST(range AS INTEGER) AS frame_idx, CAST(range AS BIGINT) AS pts, 640 AS w, 360 AS h FROM range(90)""")
def q47_synthetic_video(spark, sf_dir):
    frames.register(spark)
    return spark.read.format("shotloom_video").load().select("frame_idx", "pts", "w", "h")


@query("""SELECT CAST(range AS INTEGER) AS frame_idx, CASE WHEN range < 15 THEN 1 ELSE 0 END AS n_faces, CASE WHEN range >= 15 THEN 'RuntimeError: no face' END AS error FROM range(30)""")
def q48_detector(spark, sf_dir):
    """The detector's plug-in point with a stand-in: one face on the first colour, a failure on the second."""
    frames.register(spark)
    v = spark.read.format("shotloom_video").options(pixels="true", seconds="1", width="64", height="36").load()
    return models.detect(v.select(F.lit(0).cast("long").alias("key"), "frame_idx", "w", "h", "img"), _stand_in).select(
        "frame_idx", F.col("face_ord").isNotNull().cast("int").alias("n_faces"), "error"
    )


def _stand_in():
    def detect(image: np.ndarray):
        if image[0, -1, 2] != 200:
            raise RuntimeError("no face")
        return [(1, 2, 3, 4)], [[(0.0, 0.0)] * 5], [0.9]

    return detect


@query(f"""WITH RECURSIVE {OBSERVATIONS}, {FRAMES}, n AS (SELECT f.shot_id, f.frame_idx, count(obs_ord) AS d, f.frame_idx % 7 <> 6 AS ok FROM frames f LEFT JOIN obs USING (shot_id, frame_idx) GROUP BY ALL),
run AS (
  SELECT DISTINCT shot_id, -1 AS frame_idx, '' AS action, CAST(0 AS BIGINT) AS faces, CAST(0 AS BIGINT) AS t FROM frames
  UNION ALL
  SELECT shot_id, frame_idx, action, CASE action WHEN 'tracked' THEN kept WHEN 'detected' THEN d ELSE kept + d END, CASE WHEN action = 'tracked' OR d = 0 THEN t ELSE d END
  FROM (
    SELECT *, CASE WHEN faces = 0 OR frame_idx % 10 = 0 THEN 'detected' WHEN kept = t THEN 'tracked' ELSE 'fallback' END AS action
    FROM (SELECT n.shot_id, n.frame_idx, n.d, run.faces, run.t, CASE WHEN n.ok THEN run.t ELSE 0 END AS kept FROM run JOIN n ON n.shot_id = run.shot_id AND n.frame_idx = run.frame_idx + 1))
)
SELECT shot_id, frame_idx, action, CAST(faces AS INTEGER) AS n_faces FROM run WHERE frame_idx >= 0""")
def q49_frame_face_schedule(spark, sf_dir):
    """Which frames are detected, tracked or fall back when every seventh frame loses its trackers."""
    counts = observations(spark, sf_dir).groupBy("shot_id", "frame_idx").agg(F.count("*").alias("detected"))
    f = all_frames(spark, sf_dir).join(counts, ["shot_id", "frame_idx"], "left").withColumn("tracked_ok", F.col("frame_idx") % 7 != 6)
    return schedule.frame_face_schedule(f, 10).drop("closes")


def referred(spark, sf_dir):
    """Observations with the rank (ref) of an embedding, a third of their number modulo the count of embeddings; and the embeddings by rank."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    ranks = numbered(e, "vec_id", "ref")
    n = F.lit(ranks.count())
    ref = F.when(n > 0, F.pmod(F.floor(F.col("obs_ord") / 3), n))
    return observations(spark, sf_dir).withColumn("ref", ref), e.join(ranks, "vec_id").select("ref", "embedding")


def embedded(spark, sf_dir):
    """Observations with their embeddings; all are kept."""
    o, vectors = referred(spark, sf_dir)
    return o.join(vectors, "ref", "left")


@query()
def q50_identities(spark, sf_dir):
    """Tracks with local and global ids; the vectors of observations come from the embeddings table by rank, over the whole table."""
    o, vectors = referred(spark, sf_dir)
    return pipelines.resolve_identities(o, local=0.4, overall=0.5, vectors=vectors).select("shot_id", "track_id", "local_id", "global_id")


@query(f"""WITH {OBSERVATIONS} SELECT obs_ord, x1 + 60 AS x, y1 + 10 AS y FROM obs""")
def q51_mouth_midpoint(spark, sf_dir):
    points = F.array(*[F.struct((F.col("x1") + dx).alias("x"), (F.col("y1") + dy).alias("y")) for dx, dy in ((0, 0), (1, 1), (2, 2), (40, 5), (81, 16))])
    return observations(spark, sf_dir).select("obs_ord", *[c.alias(n) for n, c in zip("xy", G.mouth_midpoint(points))])


@query(f"""WITH {OBSERVATIONS}, {FRAMES}, g AS (SELECT shot_id, frame_idx, count(*) FILTER (x2 <= {WIDTH // 2}) AS n FROM obs GROUP BY ALL) SELECT shot_id, max(CASE WHEN frame_idx % 2 = 0 THEN n ELSE 0 END) AS most FROM g GROUP BY shot_id""")
def q52_most_faces(spark, sf_dir):
    drawn = render.drawn_faces(observations(spark, sf_dir), ["shot_id", "frame_idx"], WIDTH // 2, HEIGHT)
    return render.most_faces(drawn, "shot_id", F.col("frame_idx") % 2 == 0)


@query(shot_schedule_sql("f.frame_idx % 7 <> 6") + " SELECT shot_id, frame_idx, action, CAST(faces AS INTEGER) AS n_faces, action = 'fallback' AS closes FROM run WHERE frame_idx >= 0")
def q53_shot_schedule(spark, sf_dir):
    """Every frame's action by the shot schedule when every seventh frame loses its trackers: scheduled, without a face, tracked or fallback."""
    counts = observations(spark, sf_dir).groupBy("shot_id", "frame_idx").agg(F.count("*").alias("detected"))
    f = all_frames(spark, sf_dir).join(counts, ["shot_id", "frame_idx"], "left").withColumn("tracked_ok", F.col("frame_idx") % 7 != 6)
    return schedule.shot_schedule(f, 10)


def _clip(spark):
    """The synthetic clip written to a container of its own."""
    frames.register(spark)
    v = spark.read.format("shotloom_video").options(pixels="true", seconds="1", fps="10", width="64", height="36").load()
    return video.written_y4m(v.withColumn("path", F.lit("clip.y4m")), "path", "frame_idx", 10)


@query("""SELECT 'clip.y4m' AS path, 10.0::DOUBLE AS fps, 1 AS tb_num, 10 AS tb_den, 64 AS w, 36 AS h, 10 AS n_frames, CAST(NULL AS VARCHAR) AS error
UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, NULL, 'ValueError: not a YUV4MPEG2 stream'""")
def q54_container_info(spark, sf_dir):
    broken = spark.createDataFrame([("broken", bytearray(b"no video"))], "path string, content binary")
    return video.video_info(_clip(spark).unionByName(broken))


@query("""SELECT CAST(range AS INTEGER) AS frame_idx, range AS pts, range / 10.0::DOUBLE AS time_sec, CASE WHEN range < 5 THEN 200 ELSE 40 END AS red FROM range(3, 8)""")
def q55_container_frames(spark, sf_dir):
    """Frames 3 to 7 of the container, by a seek with preroll, and the red of a corner pixel to the nearest 20."""
    found = video.read_frames(_clip(spark), 3, 7)
    red = F.conv(F.hex(F.substring("img", 3, 1)), 16, 10).cast("int")
    return found.select("frame_idx", "pts", "time_sec", (F.round(red / 20) * 20).cast("int").alias("red"))


@query("""SELECT CAST(range AS INTEGER) AS frame_idx, CASE WHEN range IN (0, 4, 8) THEN 'detected' WHEN range IN (6) THEN 'fallback' ELSE 'tracked' END AS action,
  CASE WHEN range < 4 THEN 0 WHEN range < 6 THEN 1 WHEN range < 8 THEN 2 ELSE 3 END AS track_id, CAST(range AS INTEGER) AS x1 FROM range(10)""")
def q56_trackers(spark, sf_dir):
    """The trackers' plug-in point with stand-ins: a box that moves a pixel a frame, lost in frame 6, detected every fourth frame."""
    f = spark.range(10).select(F.lit(0).cast("long").alias("shot_id"), F.col("id").cast("int").alias("frame_idx"), F.lit(1).alias("w"), F.lit(1).alias("h"), F.unhex(F.lpad(F.hex("id"), 6, "0")).alias("img"))
    return trackers.track(f, _box_at_number, _follow_number, 4).select("frame_idx", "action", "track_id", "x1")


def _box_at_number():
    return lambda image: [(int(image[0, 0, 2]), 0, 5, 5)]


def _follow_number():
    class Follow:
        def __init__(self, image, box):
            pass

        def update(self, image):
            x = int(image[0, 0, 2])
            return x != 6, (x, 0, 5, 5)

    return Follow


@query("""SELECT CAST(range AS INTEGER) AS frame_idx, 0 AS point, range * 2.0::DOUBLE AS x, range < 3 AS found FROM range(3)
UNION ALL SELECT CAST(range AS INTEGER), 0, 4.0::DOUBLE, false FROM range(3, 5)""")
def q57_optical_flow(spark, sf_dir):
    """The optical flow's plug-in point with a stand-in: two pixels a frame to the right, lost from frame 3 on."""
    f = spark.range(5).select(F.lit(0).cast("long").alias("shot_id"), F.col("id").cast("int").alias("frame_idx"), F.lit(1).alias("w"), F.lit(1).alias("h"), F.unhex(F.lpad(F.hex("id"), 6, "0")).alias("img"))
    p = spark.createDataFrame([(0, 0, 0.0, 0.0)], "shot_id long, point int, x double, y double")
    return trackers.flow(f, p, _two_pixels).select("frame_idx", "point", "x", "found")


def _two_pixels():
    return lambda before, now, points: (points + [2.0, 0.0], np.full(len(points), now[0, 0, 2] < 3))


@query("""SELECT CAST(range AS BIGINT) AS id, CASE WHEN range < 8 THEN 112 END AS w, CASE WHEN range < 8 THEN 112 END AS h, range < 8 AS fine FROM range(10)""")
def q58_aligned_faces(spark, sf_dir):
    """Faces of the clip aligned by five landmarks; the last two have four."""
    marks = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((20, 12), (40, 12), (30, 18), (22, 26), (38, 26))])
    v = video.read_frames(_clip(spark)).select(F.col("frame_idx").cast("long").alias("id"), "w", "h", "img")
    v = v.withColumn("landmarks", F.when(F.col("id") < 8, marks).otherwise(F.slice(marks, 1, 4)))
    return models.aligned(v).select("id", "w", "h", F.col("error").isNull().alias("fine"))


@query("""SELECT CAST(range AS BIGINT) AS id, CAST(CASE WHEN range < 9 THEN least(64, range * 8 + 10) - range * 8 END AS INTEGER) AS w, CASE WHEN range < 8 THEN 20 END AS h FROM range(8)
UNION ALL SELECT CAST(range AS BIGINT), NULL, NULL FROM range(8, 10)""")
def q59_cropped_faces(spark, sf_dir):
    """Boxes that move to the right, cut at the image's edge; beyond it there is no crop."""
    v = video.read_frames(_clip(spark)).select(F.col("frame_idx").cast("long").alias("id"), "w", "h", "img")
    boxes = {"x1": F.col("id") * 8, "y1": F.lit(-3), "x2": F.col("id") * 8 + 10, "y2": F.lit(20)}
    return models.cropped(v.withColumns({k: c.cast("int") for k, c in boxes.items()})).select("id", "w", "h")


@query(f"""WITH {OBSERVATIONS} SELECT obs_ord, x1 + 90 < 1000 AND y1 + 30 < 270 AS inside FROM obs""")
def q60_mouth_flags(spark, sf_dir):
    """Whether the mouth of each face lies in an image of 1000 x 270; the eyes don't matter."""
    points = F.array(*[F.struct((F.col("x1") + dx).alias("x"), (F.col("y1") + dy).alias("y")) for dx, dy in ((5000, 0), (-9000, 0), (60, 20), (30, 30), (90, 10))])
    return observations(spark, sf_dir).select("obs_ord", G.mouth_inside(points, 1000, 270).alias("inside"))


@query(f"""WITH {OBSERVATIONS} SELECT shot_id, frame_idx, 'box' AS kind, greatest(0, x1 + 25) AS x1, greatest(0, y1 + 5) AS y1, greatest(0, x1 + 25) + 70 AS x2, greatest(0, y1 + 5) + 30 AS y2, '255,255,0' AS colour, CAST(NULL AS VARCHAR) AS text FROM obs
UNION ALL SELECT conv_id, t, 'text', 10, 30, 10, 30, CASE WHEN t IN (turn * 10, turn * 10 + 9) THEN '0,0,255' ELSE '0,255,0' END,
  'shot ' || (turn + 1) || CASE t WHEN turn * 10 THEN ' start' WHEN turn * 10 + 9 THEN ' end' ELSE '' END
FROM (SELECT conv_id, turn, CAST(unnest(range(turn * 10, turn * 10 + 10)) AS INTEGER) AS t FROM conversations WHERE turn % 5 <> 3)""")
def q61_label_commands(spark, sf_dir):
    """Draw rows of mouths, and of shot numbers on the frames of each conversation's turns."""
    points = F.array(*[F.struct((F.col("x1") + dx).alias("x"), (F.col("y1") + dy).alias("y")) for dx, dy in ((40, 40), (80, 40), (60, 30), (30, 10), (90, 10))])
    mouths = render.mouth_commands(observations(spark, sf_dir).withColumn("landmarks", points), "shot_id")
    marked = overlay.expand(_turns(spark, sf_dir), "conv_id", "turn")
    labels = render.shot_labels(marked, "conv_id").withColumnRenamed("conv_id", "shot_id")
    return mouths.unionByName(labels).withColumn("colour", F.array_join(F.col("colour").cast("array<string>"), ","))


@query(f"""WITH {SEGMENTS} SELECT user_id, shot_number, first_frame, last_frame, CAST(CASE WHEN shot_number % 2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS face_count, CASE WHEN shot_number % 2 = 1 THEN 25.0::DOUBLE END AS center_x FROM segments""")
def q62_shot_feature_documents(spark, sf_dir):
    """Shots and the faces of their middle frames written as documents and read again; every second shot has a face."""
    e = table(spark, sf_dir, "events")
    s = _segments(spark, sf_dir)
    middle = s.where("shot_number % 2 = 1").select("user_id", X.middle_frame(F.col("first_frame"), F.col("last_frame")).alias("frame_idx"))
    faces = middle.select("user_id", "frame_idx", F.lit(0).alias("face_ord"), F.lit(10).alias("x1"), F.lit(10).alias("y1"), F.lit(40).alias("x2"), F.lit(50).alias("y2"))
    totals = e.groupBy("user_id").agg(F.count("*").cast("int").alias("n_frames"))
    docs = pipelines.shot_features(e, "user_id", ["ts", "event_id"], "value", totals, faces, 100, 100)
    return documents.shots(docs, "user_id").select("user_id", "shot_number", "first_frame", "last_frame", "face_count", F.col("face_details")[0]["center_x"].alias("center_x"))


@query(f"""WITH RECURSIVE {OBSERVATIONS}, {FRAMES}, n AS (SELECT f.shot_id, f.frame_idx, count(obs_ord) AS d, f.frame_idx % 7 <> 6 AS ok FROM frames f LEFT JOIN obs USING (shot_id, frame_idx) GROUP BY ALL),
run AS (
  SELECT DISTINCT shot_id, -1 AS frame_idx, '' AS action, CAST(0 AS BIGINT) AS faces, CAST(0 AS BIGINT) AS t FROM frames
  UNION ALL
  SELECT shot_id, frame_idx, action, CASE WHEN action = 'tracked' OR action = 'fallback' AND d = 0 THEN kept ELSE least(d, 1) END, CASE WHEN action = 'tracked' OR d = 0 THEN t ELSE d END
  FROM (
    SELECT *, CASE WHEN faces = 0 OR frame_idx % 10 = 0 THEN 'detected' WHEN kept = t THEN 'tracked' ELSE 'fallback' END AS action
    FROM (SELECT n.shot_id, n.frame_idx, n.d, run.faces, run.t, CASE WHEN n.ok THEN run.t ELSE 0 END AS kept FROM run JOIN n ON n.shot_id = run.shot_id AND n.frame_idx = run.frame_idx + 1))
)
SELECT shot_id, frame_idx, action, CAST(faces AS INTEGER) AS n_faces FROM run WHERE frame_idx >= 0""")
def q63_mouth_schedule(spark, sf_dir):
    """The mouth renderer's schedule, with one face drawn of each detection, and trackers lost in every seventh frame."""
    counts = observations(spark, sf_dir).groupBy("shot_id", "frame_idx").agg(F.count("*").alias("detected"))
    f = all_frames(spark, sf_dir).join(counts, ["shot_id", "frame_idx"], "left").withColumn("tracked_ok", F.col("frame_idx") % 7 != 6)
    return schedule.mouth_schedule(f.withColumn("drawn", F.least("detected", F.lit(1))), 10).drop("closes")


@query(f"WITH {TRACKS} SELECT shot_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n_obs FROM tracked GROUP BY ALL")
def q64_stream_tracks(spark, sf_dir):
    """The observations read as a stream of files, and the tracks it emits as they close; one late row moves the watermark beyond all."""
    began, place = 1_700_000_000, new_path(spark, "stream")
    o = observations(spark, sf_dir)
    end = spark.createDataFrame([(-1, 10_000, 0, 0, 0, 1, 1)], ", ".join(f"{c} {t}" for c, t in o.dtypes))
    o.unionByName(end).write.parquet(f"{place}/in")
    stream = streams.with_event_time(spark.readStream.schema(o.schema).parquet(f"{place}/in"), start=began)
    out = streams.stream_tracks(stream, start=began)
    run = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out").where("shot_id >= 0")


@query("SELECT CAST(range AS BIGINT) AS id, 512 AS length, 1.0::DOUBLE AS norm, range % 7 AS place FROM range(40)")
def q65_embeddings(spark, sf_dir):
    """The embedder's plug-in point with a stand-in: the picture's first number, modulo 7, is the vector's only component."""
    img = F.concat(F.unhex(F.lpad(F.hex("id"), 2, "0")), F.expr(f"unhex(repeat('00', {112 * 112 * 3 - 1}))"))
    crops = spark.range(40).select("id", F.lit(112).alias("w"), F.lit(112).alias("h"), img.alias("img"))
    e = models.embed(crops, _one_hot)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    place = F.array_position(F.transform("embedding", lambda x: x > 0), True) - 1
    return e.select("id", F.size("embedding").alias("length"), size.alias("norm"), place.alias("place"))


def _one_hot():
    def embed(images):
        out = np.zeros((len(images), 512), np.float32)
        out[np.arange(len(images)), images[:, 0, 0, 0] % 7] = 3
        return out

    return embed


@query("""SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS usable, vec_id % 5 <> 0 AS given FROM embeddings""")
def q66_usable_embeddings(spark, sf_dir):
    """Of five vectors one is missing, one has a component that isn't finite, one is too short."""
    k = F.col("vec_id") % 5
    v = F.when(k == 1, F.transform("embedding", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x))).when(k == 2, F.slice("embedding", 1, 3)).when(k > 2, F.col("embedding"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), v.alias("v"))
    width = F.lit(e.agg(F.max("n")).head()[0] or 0)
    return e.select("vec_id", V.usable(F.col("v"), width).alias("usable"), F.col("v").isNotNull().alias("given"))


@query(CLAIMS + " SELECT shot_id, track_id, item_ord, CAST(rk AS INTEGER) AS rank FROM ranked WHERE track_id % 4 <> 1")
def q67_claims_with_skips(spark, sf_dir):
    """Every fourth candidate is skipped, and makes no claim."""
    o = observations(spark, sf_dir)
    cand = o.select("shot_id", "frame_idx", F.col("obs_ord").alias("track_id"), *[F.col(s).alias("c" + s) for s in G.SIDES])
    item = o.select("shot_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("obs_ord").alias("item_ord"), *G.SIDES)
    ranked = tracking.claims(cand, item, ["shot_id", "frame_idx"], G.iou(G.box("c"), G.box()), 0.3, skip=F.col("track_id") % 4 == 1)
    return ranked.select("shot_id", "track_id", "item_ord", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {TRACKS}, s AS (SELECT shot_id, max(frame_idx) AS last_frame FROM tracked GROUP BY shot_id) SELECT shot_id, CAST(last_frame AS INTEGER) AS last_frame FROM s""")
def q68_last_frames(spark, sf_dir):
    """The last frame that any track of a shot reaches."""
    return tracking.last_frames(_tracked(spark, sf_dir))

