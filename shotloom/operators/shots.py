"""Shots: segmentation, sampling, repair and validation."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import middle_frame


def segments(frames: DataFrame, key: str, order: list[str], feature: str, threshold: float = 30.0) -> DataFrame:
    """(key, shot_number, first_frame, last_frame, n): cut where the feature jumps by more than the threshold.

    Frames are numbered from 0 in their order. The first frame starts shot 1.
    """
    line = Window.partitionBy(key).orderBy(*order)
    numbered = frames.withColumn("_i", F.row_number().over(line) - 1).withColumn("_cut", (F.abs(F.col(feature) - F.lag(feature).over(line)) > threshold).cast("int"))
    run = F.sum(F.coalesce("_cut", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    shots = numbered.withColumn("shot_number", run.cast("int"))
    return shots.groupBy(key, "shot_number").agg(F.min("_i").alias("first_frame"), F.max("_i").alias("last_frame"), F.count("*").alias("n"))


def from_scenes(scenes: DataFrame, key: str, total: Column | int) -> DataFrame:
    """Half-open scenes (key, number, start, stop) as closed shots with their middle frame; the last reaches the video's end."""
    last = F.max("number").over(Window.partitionBy(key))
    end = F.col("stop") - 1
    shots = scenes.withColumn("last_frame", end).withColumn("mid_frame", middle_frame(F.col("start"), end))
    return repaired(shots.withColumn("_last", F.col("number") == last).withColumnsRenamed({"start": "first_frame", "number": "shot_number"}), total, F.col("_last")).drop("_last", "stop")


def repaired(shots: DataFrame, total: Column | int, is_last: Column) -> DataFrame:
    """The last shot extended to the last frame of the video, if it ends before."""
    total = total if isinstance(total, Column) else F.lit(total)
    return shots.withColumn("last_frame", F.when(is_last & (F.col("last_frame") < total - 1), total - 1).otherwise(F.col("last_frame")))


def middle_frames(shots: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """The frame in the middle of each shot: point lookups as an equi-join."""
    wanted = shots.select(key, "shot_number", middle_frame(F.col("first_frame"), F.col("last_frame")).alias("frame_idx"))
    return wanted.join(frames, [key, "frame_idx"])


# Validation: violations as rows (key, rule, shot_number, message).
# The messages of the number, contiguity, coverage and face count rules, which others parse.


def _found(df: DataFrame, key: str, rule: str, number, message) -> DataFrame:
    return df.select(key, F.lit(rule).alias("rule"), F.col(number).cast("int").alias("shot_number"), message.alias("message"))


def number_errors(shots: DataFrame, key: str, order: str) -> DataFrame:
    """Shot numbers must be 1, 2, ... in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    bad = shots.withColumn("_n", place).where("shot_number <> _n")
    return _found(bad, key, "number", "shot_number", F.format_string("shot_number mismatch at array index %d: expected %d, got %d", F.col("_n") - 1, F.col("_n"), F.col("shot_number").cast("int")))


def contiguity_errors(shots: DataFrame, key: str, order: str) -> DataFrame:
    """A shot must start right after the one before."""
    want = F.lag(F.col("last_frame") + 1).over(Window.partitionBy(key).orderBy(order))
    bad = shots.withColumn("_want", want).where("first_frame <> _want")
    return _found(bad, key, "contiguity", "shot_number", F.format_string("contiguity: shot %d first_frame %d != previous last_frame+1 (%d)", F.col("shot_number").cast("int"), F.col("first_frame").cast("int"), F.col("_want").cast("int")))


def coverage_errors(shots: DataFrame, totals: DataFrame, key: str, order: str) -> DataFrame:
    """The last shot must end at the video's last frame; totals is (key, n_frames)."""
    last = shots.groupBy(key).agg(F.max_by(F.struct("shot_number", "last_frame"), order).alias("_s")).select(key, "_s.*")
    bad = last.join(totals.where("n_frames is not null"), key).where("last_frame <> n_frames - 1")
    return _found(bad, key, "coverage", "shot_number", F.format_string("coverage: final shot last_frame %d != total_frame_count-1 (%d)", F.col("last_frame").cast("int"), (F.col("n_frames") - 1).cast("int")))


def face_count_message(count: Column, details: Column) -> Column:
    """The inconsistency of a face count with its list (null: absent), or null."""
    n = F.size(details)
    return (
        F.when(count.isNull(), "missing face_count in detected_faces")
        .when((count > 0) & details.isNull(), "face_count > 0 but face_details is missing")
        .when((count > 0) & (n != count), F.concat(F.lit("face_count ("), count.cast("string"), F.lit(") does not match len(face_details) ("), n.cast("string"), F.lit(")")))
        .when((count == 0) & details.isNotNull(), "face_count == 0 but face_details is present")
    )


def face_count_errors(shots: DataFrame, key: str) -> DataFrame:
    """shots with columns face_count and face_details."""
    bad = shots.withColumn("_m", face_count_message(F.col("face_count"), F.col("face_details"))).where("_m is not null")
    return _found(bad, key, "face_count", "shot_number", F.concat(F.lit("shot "), F.coalesce(F.col("shot_number").cast("string"), F.lit("None")), F.lit(": "), F.col("_m")))


#: The structure of a shots document, as a JSON schema; titles name the levels in messages. load_schema() reads another from a file.
_PERCENT = {"type": "number", "minimum": 0, "maximum": 100}
_FRAME = {"type": "integer", "minimum": 0}
SCHEMA = {
    "type": "object", "required": ["shots"], "additionalProperties": False,
    "properties": {"shots": {"type": "array", "minItems": 1, "items": {
        "title": "shot", "type": "object", "required": ["shot_number", "first_frame", "last_frame", "detected_faces"], "additionalProperties": False,
        "properties": {
            "shot_number": {"type": "integer", "minimum": 1}, "first_frame": _FRAME, "last_frame": _FRAME,
            "detected_faces": {"type": "object", "title": "detected_faces", "required": ["face_count"], "properties": {
                "face_count": {"type": "integer", "minimum": 0},
                "face_details": {"type": "array", "items": {"title": "face", "type": "object", "required": ["center_x", "center_y", "face_width", "face_height"], "properties": {
                    "face_label": {"type": "string"}, "center_x": _PERCENT, "center_y": _PERCENT, "face_width": _PERCENT, "face_height": _PERCENT}}},
            }},
            "detected_graphics": {"type": "object", "maxProperties": 0},
        },
    }}},
}
_KINDS = {"integer": r"^(TINYINT|SMALLINT|INT|BIGINT)$", "number": r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$", "string": "^STRING$", "object": "^OBJECT", "array": "^ARRAY"}


def _kind(value: Column) -> Column:
    """The type of a variant's value; a whole decimal counts as an integer."""
    name = F.schema_of_variant(value)
    return F.when(name.rlike(r"^DECIMAL\(\d+,0\)$"), "BIGINT").otherwise(name)


def load_schema(spark: SparkSession, path: str) -> dict:
    """A JSON schema file, read through Spark."""
    return json.loads(spark.read.text(path, wholetext=True).head()[0])


def _checks(value: Column, where: str, rules: dict) -> list[Column]:
    """Messages of one object: wrong type, missing or unknown fields, types, bounds and sizes of its fields; nulls where all is well."""
    is_object = _kind(value).rlike(_KINDS["object"])
    out = [F.when(~is_object, F.lit(f"{where}: is not of type 'object'"))]
    fields = rules.get("properties", {})
    if rules.get("additionalProperties") is False:
        extra = F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>"))
        out.append(F.when(is_object & (F.size(extra) > 0), F.concat(F.lit(f"{where}: additional properties are not allowed: "), F.array_join(F.sort_array(extra), ", "))))
    for name in [*fields, *(n for n in rules.get("required", ()) if n not in fields)]:
        rule = fields.get(name, {})
        v = F.try_variant_get(value, f"$.{name}", "variant")
        if name in rules.get("required", ()):
            out.append(F.when(is_object & v.isNull(), F.lit(f"{where}: '{name}' is a required property")))
        fits = F.lit(True)
        if rule.get("type") in _KINDS:
            fits = _kind(v).rlike(_KINDS[rule["type"]])
            out.append(F.when(v.isNotNull() & ~fits, F.lit(f"{where}.{name}: is not of type '{rule['type']}'")))
        number = F.try_variant_get(v, "$", "double")
        if "minimum" in rule:
            out.append(F.when(fits & (number < rule["minimum"]), F.lit(f"{where}.{name}: is less than the minimum of {rule['minimum']}")))
        if "maximum" in rule:
            out.append(F.when(fits & (number > rule["maximum"]), F.lit(f"{where}.{name}: is greater than the maximum of {rule['maximum']}")))
        if "minItems" in rule:
            too_few = "should be non-empty" if rule["minItems"] == 1 else f"has fewer than {rule['minItems']} items"
            out.append(F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) < rule["minItems"], F.lit(f"{where}.{name}: {too_few}")))
        if "maxProperties" in rule:
            out.append(F.when(F.size(F.try_variant_get(v, "$", "map<string,variant>")) > rule["maxProperties"], F.lit(f"{where}.{name}: has too many properties")))
    return out


def schema_errors(documents: DataFrame, key: str, text: str = "document", schema: dict = SCHEMA) -> DataFrame:
    """(key, rule, shot_number, message) of structural faults of documents given as JSON text.

    Of JSON schemas these keywords count: type, required, properties,
    additionalProperties (false), items, minimum, maximum, minItems and
    maxProperties. shot_number is the place in the outermost array, from 1.
    """
    rows = documents.select(key, F.try_parse_json(text).alias("_v"), F.lit(None).cast("int").alias("shot_number"))
    found: list[DataFrame] = []

    def visit(level: DataFrame, where: str, rules: dict, more: list[Column] = ()) -> None:
        checks = F.array(*_checks(F.col("_v"), where, rules), *more)
        found.append(level.select(key, "shot_number", F.explode(F.filter(checks, lambda m: m.isNotNull())).alias("message")))
        for name, rule in rules.get("properties", {}).items():
            inner = F.try_variant_get("_v", f"$.{name}", "variant")
            if rule.get("type") == "object" and ("properties" in rule or "required" in rule):
                visit(level.select(key, "shot_number", inner.alias("_v")).where("_v is not null"), rule.get("title", f"{where}.{name}"), rule)
            elif rule.get("type") == "array" and rule.get("items", {}).get("type") == "object":
                each = level.select(key, "shot_number", F.posexplode(F.try_variant_get("_v", f"$.{name}", "array<variant>")).alias("_i", "_v"))
                visit(each.select(key, F.coalesce("shot_number", F.col("_i") + 1).alias("shot_number"), "_v"), rule["items"].get("title", f"{where}.{name}"), rule["items"])

    visit(rows, "$", schema, [F.when(F.col("_v").isNull(), F.lit("$: is not JSON"))])
    return reduce(DataFrame.unionByName, found).select(key, F.lit("schema").alias("rule"), "shot_number", "message")
