"""Nested JSON documents, read into typed relations and written from them. Inputs are text columns or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rounded
from . import schemas as S

STRICT = {"mode": "FAILFAST"}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, document): one row for each file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def write_text(documents: DataFrame, path: str, text: str = "document") -> None:
    """One document a line, as many files as partitions."""
    documents.select(text).write.text(path)


def _needed(value: Column, name: str) -> Column:
    """value, or a failure that names the missing field."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"missing: {name}"))).otherwise(value)


def _joined(items: Column, order: str, head: str, tail: str) -> Column:
    """The JSON texts of a group's rows (column _j) in order, as one array between head and tail."""
    listed = F.sort_array(F.collect_list(F.struct(order, items.alias("_j"))))
    return F.concat(F.lit(head), F.array_join(F.transform(listed, lambda s: s["_j"]), ","), F.lit(tail))


# Shots documents


def shots(documents: DataFrame, key: str, text: str = "document") -> DataFrame:
    """(key, pos, shot_number, first_frame, last_frame, face_count, face_details); broken JSON fails."""
    rows = documents.select(key, F.posexplode(F.from_json(text, S.SHOTS_DOC, STRICT)["shots"]).alias("pos", "s"))
    return rows.select(key, "pos", "s.shot_number", "s.first_frame", "s.last_frame", "s.detected_faces.face_count", "s.detected_faces.face_details")


def shots_document(shots: DataFrame, key: str) -> DataFrame:
    """(key, document) from shots(); face_details are left out where the count is 0."""
    details = F.when(F.col("face_count") > 0, F.col("face_details")).alias("face_details")
    graphics = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("detected_graphics")
    shot = F.struct("shot_number", "first_frame", "last_frame", F.struct("face_count", details).alias("detected_faces"), graphics)
    return shots.groupBy(key).agg(_joined(F.to_json(shot), "pos", '{"shots":[', "]}").alias("document"))


# Tracks documents


def tracks(documents: DataFrame, key: str, text: str = "document") -> DataFrame:
    """(key, shot_id, track_id, face_label, vchunk_id, pos, frame_idx, bbox, confidence, embedding), a row for each observation.

    A missing shot_id, track_id, observations, frame_idx or bbox fails, as does a
    box that isn't four integers. An absent confidence is 1.0, a null one null.
    """
    t, o = F.col("_t"), F.col("_o")
    raw = documents.select(key, F.explode(F.try_variant_get(F.parse_json(text), "$.tracks", "array<variant>")).alias("_t"))
    seen = F.variant_get(t, "$.observations", "array<variant>")
    head = raw.select(
        key, _needed(F.variant_get(t, "$.shot_id", "bigint"), "shot_id").alias("shot_id"), _needed(F.variant_get(t, "$.track_id", "int"), "track_id").alias("track_id"),
        F.try_variant_get(t, "$.face_label", "int").alias("face_label"), F.try_variant_get(t, "$.vchunk_id", "int").alias("vchunk_id"),
        F.posexplode(seen).alias("pos", "_o"), seen.isNull().alias("_none"),
    )
    box = F.variant_get(o, "$.bbox", "array<int>")
    whole = F.when(F.size(box) == 4, box).otherwise(F.raise_error(F.lit("a box is four integers")))
    return head.select(
        key, "shot_id", "track_id", "face_label", "vchunk_id", "pos", _needed(F.variant_get(o, "$.frame_idx", "int"), "frame_idx").alias("frame_idx"),
        _needed(whole, "bbox").alias("bbox"),
        F.when(F.map_contains_key(F.variant_get(o, "$", "map<string,variant>"), "confidence"), F.try_variant_get(o, "$.confidence", "double")).otherwise(1.0).alias("confidence"),
        F.try_variant_get(o, "$.embedding", "array<double>").alias("embedding"),
    )


def tracks_document(observations: DataFrame, key: str, embeddings: bool = False) -> DataFrame:
    """(key, document) from tracks(): tracks by shot and id, observations by pos; labels are kept, null ones as null."""
    fields = ["frame_idx", "bbox", "confidence", *["embedding"] * embeddings]
    one = F.to_json(F.struct(*fields))
    listed = observations.groupBy(key, "shot_id", "track_id").agg(
        F.first("face_label").alias("face_label"), F.first("vchunk_id").alias("vchunk_id"), _joined(one, "pos", "[", "]").alias("_all"),
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    names = ("shot_id", "track_id", "face_label", "vchunk_id")
    track = F.concat(*[x for i, c in enumerate(names) for x in (F.lit(("{" if not i else ",") + f'"{c}":'), text(c))], F.lit(',"observations":'), F.col("_all"), F.lit("}"))
    place = listed.withColumn("_place", F.struct("shot_id", "track_id"))
    return place.groupBy(key).agg(_joined(track, "_place", '{"tracks":[', "]}").alias("document"))


# Per-frame face lists


def frame_faces(documents: DataFrame, key: str, text: str = "document") -> DataFrame:
    """(key, pos, frame, faces) from either {"frames": [..]} or a bare array; an entry that isn't an object fails."""
    doc = F.parse_json(text)
    entries = F.coalesce(F.try_variant_get(doc, "$.frames", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    rows = documents.select(key, F.posexplode(entries).alias("pos", "_e"))
    fine = F.schema_of_variant("_e").startswith("OBJECT")
    entry = F.when(fine, F.col("_e")).otherwise(F.raise_error(F.lit("a frame entry is an object")))
    return rows.select(key, "pos", F.try_variant_get(entry, "$.frame", "int").alias("frame"), F.try_variant_get(entry, "$.faces", f"array<{S.FRAME_FACE}>").alias("faces"))


def frame_faces_document(faces: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """(key, document): an entry for every frame, empty where it has no face. faces has face_ord, x, y, w, h, conf, source."""
    listed = faces.groupBy(key, "frame_idx").agg(_joined(F.to_json(F.struct("x", "y", "w", "h", rounded(F.col("conf"), 3).alias("conf"), "source")), "face_ord", "[", "]").alias("_f"))
    rows = frames.select(key, "frame_idx").join(listed, [key, "frame_idx"], "left")
    entry = F.concat(F.lit('{"frame":'), F.col("frame_idx").cast("string"), F.lit(',"faces":'), F.coalesce("_f", F.lit("[]")), F.lit("}"))
    return rows.groupBy(key).agg(_joined(entry, "frame_idx", "[", "]").alias("document"))


# Maps


def local_id_map(tracks: DataFrame) -> DataFrame:
    """(shot_id, ids): map from track to face_N; null ids are left out, a shot with none keeps an empty map."""
    pair = F.struct("track_id", F.concat(F.lit("face_"), F.col("local_id").cast("string")).alias("name"))
    return tracks.groupBy("shot_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("local_id").isNotNull(), pair)))).alias("ids"))


def embeddings(documents: DataFrame, key: str, text: str = "document") -> DataFrame:
    """(key, shot_id, frame_idx, track_id, embedding) from shot -> frame -> track -> vector; shots without frames stay as a row of nulls."""
    rows = documents.select(key, F.explode(F.from_json(text, S.EMBEDDINGS, STRICT)).alias("shot_id", "_f"))
    rows = rows.select(key, "shot_id", F.explode_outer("_f").alias("frame_idx", "_t"))
    return rows.select(key, "shot_id", "frame_idx", F.explode_outer("_t").alias("track_id", "embedding"))


def embeddings_document(rows: DataFrame, key: str) -> DataFrame:
    """(key, document): the inverse of embeddings()."""
    entry = lambda k, v: F.map_from_entries(F.filter(F.collect_list(F.struct(k, v)), lambda e: e[k].isNotNull()))
    tracks = rows.groupBy(key, "shot_id", "frame_idx").agg(entry("track_id", "embedding").alias("_t"))
    frames = tracks.groupBy(key, "shot_id").agg(entry("frame_idx", "_t").alias("_f"))
    return frames.groupBy(key).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("shot_id", "_f")))).alias("document"))
