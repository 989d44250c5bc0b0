"""Queries over the engine's operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vectors as V
from ..operators import identity, overlay, schedule, shots, tracking
from ..sources import documents, frames
from .fixtures import ASPECT, DAYS, FRAMES, HEIGHT, OBSERVATIONS, TRACKS, WIDTH, all_frames, observations, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.link_tracks(observations(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.segments(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as shot lists with every fifth turn from the fourth missing: turn t is shot t + 1 of ten frames."""
    c = table(spark, sf_dir, "conversations").where("turn % 5 <> 3")
    return c.select("conv_id", "turn", (F.col("turn") + 1).cast("int").alias("shot_number"), (F.col("turn") * 10).cast("int").alias("first_frame"), (F.col("turn") * 10 + 9).cast("int").alias("last_frame"))


TURNS = "turns AS (SELECT conv_id, turn, CAST(turn + 1 AS INTEGER) AS shot_number, CAST(turn * 10 AS INTEGER) AS first_frame, CAST(turn * 10 + 9 AS INTEGER) AS last_frame FROM conversations WHERE turn % 5 <> 3)"
SEGMENTS = """
numbered AS (
  SELECT user_id, value, row_number() OVER w - 1 AS i, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
cuts AS (SELECT *, sum(CASE WHEN abs(value - before) > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) + 1 AS s FROM numbered),
segments AS (
  SELECT user_id, CAST(s AS INTEGER) AS shot_number, CAST(min(i) AS INTEGER) AS first_frame, CAST(max(i) AS INTEGER) AS last_frame, count(*) AS n FROM cuts GROUP BY user_id, s
)"""


@query(f"""WITH {OBSERVATIONS}, pairs AS (
  SELECT a.shot_id, a.obs_ord AS obs_a, b.obs_ord AS obs_b,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter
  FROM obs a JOIN obs b ON a.shot_id = b.shot_id AND b.frame_idx = a.frame_idx + 1)
SELECT shot_id, obs_a, obs_b, round(CAST(inter AS DOUBLE) / (28800 - inter), 9) AS iou FROM pairs WHERE inter > 0""")
def q01_iou_pairs(spark, sf_dir):
    """Overlapping boxes of adjacent frames."""
    o = observations(spark, sf_dir)
    a, b = (o.select("shot_id", (F.col("frame_idx") + 1 if s == "a" else F.col("frame_idx")).alias("f"), F.col("obs_ord").alias(f"obs_{s}"), *[F.col(c).alias(s + c) for c in G.SIDES]) for s in "ab")
    met = a.join(b, ["shot_id", "f"]).withColumn("iou", G.iou(G.box("a"), G.box("b")))
    return met.where("iou > 0").select("shot_id", "obs_a", "obs_b", F.round("iou", 9).alias("iou"))


@query(f"WITH {TRACKS} SELECT shot_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n_obs FROM tracked GROUP BY ALL")
def q02_tracks(spark, sf_dir):
    return tracking.tracks(_tracked(spark, sf_dir))


@query(f"""WITH {TRACKS} SELECT shot_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame,
  max(frame_idx) - min(frame_idx) + 1 AS duration, count(*) AS n_obs,
  {', '.join(f'arg_min({s}, frame_idx) AS first_{s}' for s in G.SIDES)}, {', '.join(f'arg_max({s}, frame_idx) AS last_{s}' for s in G.SIDES)},
  {', '.join(f'round(avg({s}), 6) AS mean_{s}' for s in G.SIDES)} FROM tracked GROUP BY ALL""")
def q03_track_summary(spark, sf_dir):
    return tracking.track_summary(_tracked(spark, sf_dir)).withColumns({f"mean_{s}": F.round(f"mean_{s}", 6) for s in G.SIDES})


@query(f"""WITH {TRACKS}, t AS (SELECT shot_id, track_id, min(frame_idx) AS a, max(frame_idx) AS b FROM tracked GROUP BY ALL)
SELECT p.shot_id, p.track_id AS track_a, q.track_id AS track_b FROM t p JOIN t q ON p.shot_id = q.shot_id AND p.track_id < q.track_id AND p.a <= q.b AND q.a <= p.b""")
def q04_track_overlap_pairs(spark, sf_dir):
    return tracking.overlap_pairs(tracking.tracks(_tracked(spark, sf_dir)))


@query(f"""WITH {OBSERVATIONS}, p AS (SELECT shot_id, obs_ord, x1, y1,
  100.0::DOUBLE * ((x1 + x2) / 2) / {WIDTH} AS cx, 100.0::DOUBLE * ((y1 + y2) / 2) / {HEIGHT} AS cy, 100.0::DOUBLE * (x2 - x1) / {WIDTH} AS fw, 100.0::DOUBLE * (y2 - y1) / {HEIGHT} AS fh FROM obs)
SELECT shot_id, obs_ord, round(cx, 9) AS center_x, round(cy, 9) AS center_y, round(fw, 9) AS face_width, round(fh, 9) AS face_height,
  CAST(trunc(cx / 100 * {WIDTH} - fw / 100 * {WIDTH} / 2) AS INTEGER) AS px1, CAST(trunc(cy / 100 * {HEIGHT} - fh / 100 * {HEIGHT} / 2) AS INTEGER) AS py1,
  CAST(trunc(cx / 100 * {WIDTH} + fw / 100 * {WIDTH} / 2) AS INTEGER) AS px2, CAST(trunc(cy / 100 * {HEIGHT} + fh / 100 * {HEIGHT} / 2) AS INTEGER) AS py2 FROM p""")
def q05_normalize_denormalize(spark, sf_dir):
    n = observations(spark, sf_dir).withColumns(G.normalized(G.box(), WIDTH, HEIGHT))
    names = ("center_x", "center_y", "face_width", "face_height")
    back = G.denormalized(*map(F.col, names), WIDTH, HEIGHT)
    return n.select("shot_id", "obs_ord", *[F.round(c, 9).alias(c) for c in names], *[c.alias("p" + s) for c, s in zip(back, G.SIDES)])


@query(f"""WITH {OBSERVATIONS}, gaps AS (
  SELECT a.shot_id, a.frame_idx, a.obs_ord, a.x1, a.y1, a.x2, a.y2,
    min(CASE WHEN b.x2 <= a.x1 THEN a.x1 - b.x2 END) AS l, min(CASE WHEN b.y2 <= a.y1 THEN a.y1 - b.y2 END) AS t,
    min(CASE WHEN b.x1 >= a.x2 THEN b.x1 - a.x2 END) AS r, min(CASE WHEN b.y1 >= a.y2 THEN b.y1 - a.y2 END) AS d
  FROM obs a LEFT JOIN obs b ON a.shot_id = b.shot_id AND a.frame_idx = b.frame_idx AND NOT (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2) GROUP BY ALL)
SELECT shot_id, frame_idx, obs_ord,
  greatest(0, x1 - greatest(least(x1, l), 20)) AS ex1, greatest(0, y1 - greatest(least(y1, t), 20)) AS ey1,
  least({WIDTH}, x2 + greatest(least({WIDTH} - x2, r), 20)) AS ex2, least({HEIGHT}, y2 + greatest(least({HEIGHT} - y2, d), 20)) AS ey2 FROM gaps""")
def q06_expanded_bbox(spark, sf_dir):
    return tracking.expanded_boxes(observations(spark, sf_dir), WIDTH, HEIGHT, ["shot_id", "frame_idx"], "obs_ord")


@query("""WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS m FROM u GROUP BY ALL)
SELECT label, CAST(i - 1 AS INTEGER) AS pos, m AS mean FROM m""")
def q07_representative_embedding(spark, sf_dir):
    """Mean vector of each label, a row for each component."""
    means = V.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COSINE} >= 0.4")
def q08_similarity_pairs(spark, sf_dir):
    return identity.similar_pairs(_vectors(spark, sf_dir), 0.4).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {COSINE} >= 0.4),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
roots AS (SELECT u AS id, min(v) AS root FROM reach GROUP BY u)
SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS global_id FROM roots""")
def q09_global_ids(spark, sf_dir):
    return identity.global_ids(_vectors(spark, sf_dir), 0.4)


@query("""WITH RECURSIVE t AS (
  SELECT label AS shot_id, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS p, vec_id % 97 AS f, CASE WHEN vec_id % 11 = 0 THEN CAST(vec_id % 5 + 100 AS INTEGER) END AS given, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.shot_id, a.p, b.p AS j, list_cosine_similarity(a.v, b.v) AS s FROM t a JOIN t b ON a.shot_id = b.shot_id AND (a.f + 5 < b.f OR b.f + 5 < a.f)),
near AS (SELECT t.shot_id, t.p, coalesce(list(j ORDER BY s DESC, j) FILTER (s >= 0.3), []) AS near FROM t LEFT JOIN pairs USING (shot_id, p) GROUP BY ALL),
first AS (
  SELECT shot_id, 1 AS p, list(given ORDER BY p) AS ids FROM t GROUP BY shot_id
  UNION ALL
  SELECT r.shot_id, r.p + 1, CASE WHEN r.ids[r.p] IS NULL THEN list_transform(r.ids, lambda x, j: CASE WHEN j = r.p THEN r.ids[list_filter(n.near, lambda k: r.ids[k] IS NOT NULL)[1]] ELSE x END) ELSE r.ids END
  FROM first r JOIN near n ON n.shot_id = r.shot_id AND n.p = r.p),
second AS (
  SELECT shot_id, 1 AS p, 0 AS number, ids FROM first WHERE p > len(ids)
  UNION ALL
  SELECT r.shot_id, r.p + 1, CASE WHEN r.ids[r.p] IS NULL THEN r.number + 1 ELSE r.number END,
    CASE WHEN r.ids[r.p] IS NULL THEN list_transform(r.ids, lambda x, j: CASE WHEN x IS NULL AND (j = r.p OR list_contains(n.near, CAST(j AS INTEGER))) THEN r.number ELSE x END) ELSE r.ids END
  FROM second r JOIN near n ON n.shot_id = r.shot_id AND n.p = r.p)
SELECT t.shot_id, t.vec_id AS track_ord, CAST(ids[t.p] AS INTEGER) AS local_id FROM t JOIN second USING (shot_id) WHERE second.p > len(ids)""")
def q10_local_ids(spark, sf_dir):
    """Greedy ids in a shot: labels as shots, vectors as tracks of six frames; every eleventh has an id already."""
    first = (F.col("vec_id") % 97).cast("int")
    given = F.when(F.col("vec_id") % 11 == 0, (F.col("vec_id") % 5 + 100).cast("int"))
    t = table(spark, sf_dir, "embeddings").select(F.col("label").alias("shot_id"), F.col("vec_id").alias("track_ord"), first.alias("first_frame"), (first + 5).alias("last_frame"), F.col("embedding").alias("mean"), given.alias("local_id"))
    return identity.local_ids(t, 0.3).select("shot_id", "track_ord", "local_id")


CLAIMS = f"""WITH {OBSERVATIONS}, pairs AS (
  SELECT a.shot_id, a.frame_idx, a.obs_ord AS track_id, b.obs_ord AS item_ord,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter
  FROM obs a JOIN obs b ON a.shot_id = b.shot_id AND b.frame_idx = a.frame_idx + 1),
scored AS (SELECT *, CAST(inter AS DOUBLE) / (28800 - inter) AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shot_id, frame_idx, track_id ORDER BY score DESC, item_ord) AS rk FROM scored WHERE score >= 0.3)"""


@query(CLAIMS + " SELECT shot_id, track_id, item_ord, round(score, 9) AS score FROM ranked WHERE rk = 1")
def q11_claims_top1(spark, sf_dir):
    o = observations(spark, sf_dir)
    cand = o.select("shot_id", "frame_idx", F.col("obs_ord").alias("track_id"), *[F.col(s).alias("c" + s) for s in G.SIDES])
    item = o.select("shot_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("obs_ord").alias("item_ord"), *G.SIDES)
    ranked = tracking.claims(cand, item, ["shot_id", "frame_idx"], G.iou(G.box("c"), G.box()), 0.3)
    return ranked.where("rank = 1").select("shot_id", "track_id", "item_ord", F.round("score", 9).alias("score"))


@query(f"WITH {SEGMENTS} SELECT * FROM segments")
def q12_shot_segmentation(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"""WITH {SEGMENTS}, m AS (SELECT user_id, shot_number, CAST(floor((first_frame + last_frame) / 2.0) AS INTEGER) AS frame_idx FROM segments)
SELECT user_id, shot_number, m.frame_idx, value FROM m JOIN numbered USING (user_id) WHERE numbered.i = m.frame_idx""")
def q13_mid_frame_lookup(spark, sf_dir):
    from pyspark.sql import Window

    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = table(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(line) - 1).alias("frame_idx"))
    return shots.middle_frames(_segments(spark, sf_dir), numbered, "user_id").select("user_id", "shot_number", "frame_idx", "value")


@query(f"""WITH {TURNS}, w AS (SELECT *, lag(last_frame + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS want FROM turns)
SELECT conv_id, 'contiguity' AS rule, shot_number, 'contiguity: shot ' || shot_number || ' first_frame ' || first_frame || ' != previous last_frame+1 (' || want || ')' AS message FROM w WHERE first_frame <> want""")
def q14_contiguity(spark, sf_dir):
    return shots.contiguity_errors(_turns(spark, sf_dir), "conv_id", "turn")


@query(f"""WITH {TURNS}, n AS (SELECT conv_id, CAST(count(*) * 10 AS INTEGER) AS n FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, arg_max(shot_number, turn) AS shot_number, arg_max(last_frame, turn) AS last_frame FROM turns GROUP BY conv_id)
SELECT conv_id, 'coverage' AS rule, shot_number, 'coverage: final shot last_frame ' || last_frame || ' != total_frame_count-1 (' || (n - 1) || ')' AS message FROM l JOIN n USING (conv_id) WHERE last_frame <> n - 1""")
def q15_coverage(spark, sf_dir):
    totals = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") * 10).cast("int").alias("n_frames"))
    return shots.coverage_errors(_turns(spark, sf_dir), totals, "conv_id", "turn")


@query("""WITH s AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS shot_number, CASE WHEN turn % 7 <> 6 THEN length(text) % 3 END AS c,
  CASE WHEN turn % 5 <> 4 THEN length(text) % 4 END AS d FROM conversations),
m AS (SELECT *, CASE WHEN c IS NULL THEN 'missing face_count in detected_faces' WHEN c > 0 AND d IS NULL THEN 'face_count > 0 but face_details is missing'
  WHEN c > 0 AND d <> c THEN 'face_count (' || c || ') does not match len(face_details) (' || d || ')' WHEN c = 0 AND d IS NOT NULL THEN 'face_count == 0 but face_details is present' END AS m FROM s)
SELECT conv_id, 'face_count' AS rule, shot_number, 'shot ' || shot_number || ': ' || m AS message FROM m WHERE m IS NOT NULL""")
def q16_face_count_rules(spark, sf_dir):
    n = F.char_length("text")
    s = table(spark, sf_dir, "conversations").select(
        "conv_id", (F.col("turn") + 1).cast("int").alias("shot_number"), F.when(F.col("turn") % 7 != 6, n % 3).alias("face_count"),
        F.when(F.col("turn") % 5 != 4, F.array_repeat(F.lit(1), n % 4)).alias("face_details"),
    )
    return shots.face_count_errors(s, "conv_id")


@query(f"""WITH {SEGMENTS}, r AS (SELECT user_id, shot_number, first_frame AS f, last_frame + CASE WHEN shot_number % 3 = 0 THEN 1 ELSE 0 END AS l FROM segments),
x AS (SELECT user_id, CAST(unnest(range(f, l + 1)) AS INTEGER) AS frame_idx, shot_number, f, l FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, frame_idx ORDER BY shot_number DESC) AS rn FROM x)
SELECT user_id, frame_idx, shot_number, CASE WHEN frame_idx = f THEN 1 WHEN frame_idx = l THEN -1 ELSE 0 END AS marker FROM t WHERE rn = 1""")
def q17_interval_expand_markers(spark, sf_dir):
    """Every third shot reaches one frame into the next, so that shots overlap."""
    longer = F.col("last_frame") + F.when(F.col("shot_number") % 3 == 0, 1).otherwise(0)
    return overlay.expand(_segments(spark, sf_dir).withColumn("last_frame", longer), "user_id", "shot_number")


@query(f"""WITH {OBSERVATIONS}, {FRAMES}
SELECT shot_id, frame_idx, count(obs_ord) AS n, coalesce(string_agg(CAST(obs_ord AS VARCHAR), ',' ORDER BY obs_ord), '') AS labels FROM frames LEFT JOIN obs USING (shot_id, frame_idx) GROUP BY ALL""")
def q18_overlay_left_join(spark, sf_dir):
    out = overlay.with_overlays(all_frames(spark, sf_dir), observations(spark, sf_dir), ["shot_id", "frame_idx"], "obs_ord", list(G.SIDES))
    return out.select("shot_id", "frame_idx", F.size("overlays").cast("long").alias("n"), F.array_join(F.transform("overlays", lambda o: o["obs_ord"].cast("string")), ",").alias("labels"))


@query(f"""WITH {OBSERVATIONS}, {FRAMES}, f AS (SELECT * FROM frames WHERE frame_idx < 20), o AS (SELECT DISTINCT shot_id, frame_idx FROM obs),
beyond AS (SELECT shot_id, frame_idx, 'beyond' AS kind, CAST(0 AS BIGINT) AS n FROM o WHERE frame_idx >= 20),
tail AS (SELECT f.shot_id, f.frame_idx, 'tail' AS kind, count(obs_ord) AS n FROM f LEFT JOIN obs USING (shot_id, frame_idx) WHERE f.frame_idx >= 10 GROUP BY ALL)
SELECT * FROM beyond UNION ALL SELECT * FROM tail""")
def q19_overlay_beyond_end(spark, sf_dir):
    """Of a video of 20 frames: overlays beyond its end, and how many its last 10 frames have."""
    o, f = observations(spark, sf_dir), all_frames(spark, sf_dir).where("frame_idx < 20")
    beyond = overlay.beyond_end(o, f, ["shot_id", "frame_idx"]).select("shot_id", "frame_idx", F.lit("beyond").alias("kind"), F.lit(0).cast("long").alias("n"))
    totals = f.select("shot_id").distinct().withColumn("n_frames", F.lit(20))
    tail = overlay.tail_probe(f, o, "shot_id", totals).select("shot_id", "frame_idx", F.lit("tail").alias("kind"), "n")
    return beyond.unionByName(tail)


CROP_W = int(HEIGHT / ASPECT)
BASE_W = repr(HEIGHT / ASPECT)
FACES = f"""{OBSERVATIONS},
g AS (
  SELECT shot_id, frame_idx, count(*) AS n, max(x2) - min(x1) AS spread, min(x1) AS ax1, min(x2) AS ax2,
    sum((x1 + x2) / 2) / count(*) AS mx, sum((y1 + y2) / 2) / count(*) AS my,
    arg_max((x1 + x2) / 2, obs_ord) - arg_min((x1 + x2) / 2, obs_ord) AS dx2, arg_max((y1 + y2) / 2, obs_ord) - arg_min((y1 + y2) / 2, obs_ord) AS dy2,
    max((x1 + x2) / 2) - min((x1 + x2) / 2) AS dx3, max((y1 + y2) / 2) - min((y1 + y2) / 2) AS dy3
  FROM obs GROUP BY ALL
),
k AS (
  SELECT *, CASE n WHEN 1 THEN 'single' WHEN 3 THEN 'turned3' WHEN 2 THEN CASE WHEN spread / {BASE_W}::DOUBLE BETWEEN 0.9 AND 1.0 THEN 'upright' ELSE 'turned2' END ELSE 'letterbox' END AS kind,
    greatest(-30.0::DOUBLE, least(30.0::DOUBLE, degrees(CASE n WHEN 3 THEN atan2(dy3, dx3) ELSE atan2(dy2, dx2) END) - 90)) AS ang
  FROM g
)"""


def _faces(spark, sf_dir):
    listed = F.sort_array(F.collect_list(F.struct("obs_ord", *G.SIDES)))
    return observations(spark, sf_dir).groupBy("shot_id", "frame_idx").agg(listed.alias("faces"))


def _planned(spark, sf_dir, every: bool):
    f = _faces(spark, sf_dir)
    if every:
        f = all_frames(spark, sf_dir).join(f, ["shot_id", "frame_idx"], "left")
        f = f.withColumn("faces", F.coalesce("faces", F.array().cast(f.schema["faces"].dataType.simpleString())))
    return f.select("shot_id", "frame_idx", G.crop_plan(F.col("faces"), WIDTH, HEIGHT, ASPECT).alias("p")).select("shot_id", "frame_idx", "p.*")


@query(f"""WITH {FACES},
c AS (SELECT k.shot_id, k.frame_idx, cos(radians(ang)) * (c.x - mx) + sin(radians(ang)) * (c.y - my) AS u, -sin(radians(ang)) * (c.x - mx) + cos(radians(ang)) * (c.y - my) AS v
  FROM k JOIN (SELECT shot_id, frame_idx, unnest([x1, x2, x1, x2]) AS x, unnest([y1, y1, y2, y2]) AS y FROM obs) c ON k.shot_id = c.shot_id AND k.frame_idx = c.frame_idx WHERE kind LIKE 'turned%'),
e AS (SELECT shot_id, frame_idx, 1.0::DOUBLE / greatest((max(u) - min(u)) / {BASE_W}::DOUBLE, (max(v) - min(v)) / {HEIGHT}.0::DOUBLE) AS scale FROM c GROUP BY ALL),
w AS (SELECT k.*, e.scale, CASE kind WHEN 'single' THEN (ax1 + ax2) // 2 - {CROP_W} // 2 ELSE CAST(trunc(mx - {CROP_W / 2}::DOUBLE) AS INTEGER) END AS l FROM k LEFT JOIN e USING (shot_id, frame_idx))
SELECT shot_id, frame_idx, kind, CAST(greatest(0, least({WIDTH - CROP_W}, l)) AS INTEGER) AS x1, 0 AS y1, CAST(greatest(0, least({WIDTH - CROP_W}, l)) + {CROP_W} AS INTEGER) AS x2, {HEIGHT} AS y2,
  CASE WHEN kind LIKE 'turned%' THEN round(ang, 6) ELSE 0.0::DOUBLE END AS angle, coalesce(round(scale, 6), 1.0::DOUBLE) AS scale FROM w WHERE n <= 3""")
def q20_crop_plan_1_2_3(spark, sf_dir):
    found = _planned(spark, sf_dir, False).where("kind <> 'letterbox'")
    return found.withColumns({c: F.round(c, 6) for c in ("angle", "scale")})


_BOX_SCALE = min(720 / WIDTH, 1560 / HEIGHT)
_BOX_W, _BOX_H = int(WIDTH * _BOX_SCALE), int(HEIGHT * _BOX_SCALE)


@query(f"""WITH {OBSERVATIONS}, {FRAMES}, g AS (SELECT f.shot_id, f.frame_idx, count(obs_ord) AS n FROM frames f LEFT JOIN obs USING (shot_id, frame_idx) GROUP BY ALL)
SELECT shot_id, frame_idx, {(720 - _BOX_W) // 2} AS x1, {(1560 - _BOX_H) // 2} AS y1, {(720 - _BOX_W) // 2 + _BOX_W} AS x2, {(1560 - _BOX_H) // 2 + _BOX_H} AS y2 FROM g WHERE n = 0 OR n > 3""")
def q21_letterbox_plan(spark, sf_dir):
    return _planned(spark, sf_dir, True).where("kind = 'letterbox'").select("shot_id", "frame_idx", *G.SIDES)


@query(f"""WITH {TRACKS}, t AS (SELECT *, CASE WHEN track_id % 3 <> 2 THEN track_id END AS v FROM tracked)
SELECT shot_id, obs_ord, 'G' || shot_id || '_V' || coalesce(CAST(v AS VARCHAR), '?') AS identity, 'Sh' || shot_id || '_Tr' || track_id || '_Fa' || coalesce(CAST(v AS VARCHAR), '?') || '_Seg?_Fr' || frame_idx AS full_label,
  'S' || shot_id || '_C' || coalesce(CAST(v AS VARCHAR), '?') AS shot_label FROM t""")
def q22_labels(spark, sf_dir):
    t = _tracked(spark, sf_dir)
    v = F.when(F.col("track_id") % 3 != 2, F.col("track_id"))
    return t.select("shot_id", "obs_ord", X.identity_label(F.col("shot_id"), v).alias("identity"), X.full_label(F.col("shot_id"), F.col("track_id"), v, F.lit(None), F.col("frame_idx")).alias("full_label"), X.shot_label(F.col("shot_id"), v).alias("shot_label"))


@query(f"""WITH {TRACKS}, t AS (SELECT DISTINCT shot_id, track_id FROM tracked)
SELECT shot_id, coalesce(string_agg(track_id || '=face_' || (track_id // 2), ',' ORDER BY track_id) FILTER (track_id % 3 <> 2), '') AS ids FROM t GROUP BY shot_id""")
def q23_vchunk_map(spark, sf_dir):
    """Two tracks share an id, every third has none; the map is written out in order of the track."""
    t = tracking.tracks(_tracked(spark, sf_dir)).withColumn("local_id", F.when(F.col("track_id") % 3 != 2, F.floor(F.col("track_id") / 2)))
    pairs = F.transform(F.map_entries("ids"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return documents.local_id_map(t).select("shot_id", F.array_join(pairs, ",").alias("ids"))


def shot_schedule_sql(held: str) -> str:
    """The shot schedule frame by frame; held is whether the trackers hold in a frame."""
    return f"""WITH RECURSIVE {OBSERVATIONS}, {FRAMES}, n AS (SELECT f.shot_id, f.frame_idx, count(obs_ord) AS d, {held} AS ok FROM frames f LEFT JOIN obs USING (shot_id, frame_idx) GROUP BY ALL),
run AS (
  SELECT DISTINCT shot_id, -1 AS frame_idx, '' AS action, CAST(0 AS BIGINT) AS faces, false AS born, false AS active, CAST(0 AS BIGINT) AS tracked FROM frames
  UNION ALL
  SELECT shot_id, frame_idx, action, CASE action WHEN 'tracked' THEN tracked ELSE d END, born OR CASE action WHEN 'tracked' THEN tracked ELSE d END > 0,
    CASE action WHEN 'tracked' THEN active ELSE d > 0 END, CASE action WHEN 'tracked' THEN tracked ELSE d END
  FROM (
    SELECT n.shot_id, n.frame_idx, n.d, run.born, run.active, run.tracked,
      CASE WHEN n.frame_idx % 10 = 0 OR NOT run.born OR NOT run.active THEN 'detected' WHEN n.ok THEN 'tracked' ELSE 'fallback' END AS action
    FROM run JOIN n ON n.shot_id = run.shot_id AND n.frame_idx = run.frame_idx + 1)
)"""


@query(shot_schedule_sql("true") + " SELECT shot_id, frame_idx FROM run WHERE action = 'detected'")
def q24_detection_schedule(spark, sf_dir):
    """All frames that are detected while trackers hold in every frame: every tenth, and any while no tracker is active."""
    counts = observations(spark, sf_dir).groupBy("shot_id", "frame_idx").agg(F.count("*").alias("detected"))
    f = all_frames(spark, sf_dir).join(counts, ["shot_id", "frame_idx"], "left").withColumn("tracked_ok", F.lit(True))
    return schedule.shot_schedule(f, 10).where("action = 'detected'").select("shot_id", "frame_idx")


@query(f"""WITH {OBSERVATIONS} SELECT obs_ord, greatest(0, x1 + 25) AS x, greatest(0, y1 - 45) AS y, 70 AS w, 80 AS h FROM
  (SELECT obs_ord, x1, y1 FROM obs)""")
def q25_mouth_box(spark, sf_dir):
    """Landmarks at fixed places of each box: eyes, then three points around the mouth."""
    places = ((40, 40), (80, 40), (60, 30), (30, -40), (90, 10))
    points = F.array(*[F.struct((F.col("x1") + dx).alias("x"), (F.col("y1") + dy).alias("y")) for dx, dy in places])
    return observations(spark, sf_dir).select("obs_ord", *[c.alias(n) for c, n in zip(G.mouth_box(points), "xywh")])


@query(f"WITH {TRACKS} SELECT shot_id, track_id, frame_idx, x1, y1, x2, y2 FROM tracked")
def q26_json_roundtrip(spark, sf_dir):
    """Tracks written as one document for each shot and read again."""
    t = _tracked(spark, sf_dir).select(
        F.col("shot_id").alias("video"), "shot_id", "track_id", F.lit(None).cast("int").alias("face_label"), F.lit(None).cast("int").alias("vchunk_id"),
        F.col("frame_idx").alias("pos"), "frame_idx", F.array(*G.SIDES).alias("bbox"), F.lit(0.5).alias("confidence"), F.lit(None).cast("array<double>").alias("embedding"),
    )
    back = documents.tracks(documents.tracks_document(t, "video"), "video")
    return back.select("shot_id", "track_id", "frame_idx", *[F.col("bbox")[i].alias(s) for i, s in enumerate(G.SIDES)])


@query(f"WITH {OBSERVATIONS} SELECT * FROM obs WHERE frame_idx BETWEEN 5 AND 12")
def q27_range_scan(spark, sf_dir):
    return frames.range_scan(observations(spark, sf_dir), 5, 12)
