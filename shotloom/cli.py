"""Commands over files: `python -m shotloom.cli {tracks,identities,validate,crops,features,visualize} --help`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import shots, tracking
from .plans import pipelines
from .sources import documents


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shotloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("tracks", "link observations (Parquet) into tracks"), ("identities", "local and global ids of tracks (Parquet with embeddings)"), ("validate", "check shots documents (JSON)"), ("crops", "portrait crop plans of face lists (JSON)"), ("features", "shots documents from frame features (Parquet: path, frame_idx, feature)"), ("visualize", "draw rows of shots documents (JSON): shot numbers and face boxes")):
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        c.add_argument("output")
        if name in ("tracks", "identities"):
            c.add_argument("--iou", type=float, default=0.5)
        if name == "identities":
            c.add_argument("--threshold", type=float, default=0.7)
        if name == "features":
            c.add_argument("--faces", required=True, help="Parquet with path, frame_idx, face_ord, x1, y1, x2, y2")
            c.add_argument("--size", type=int, nargs=2, required=True)
            c.add_argument("--threshold", type=float, default=30.0)
        if name == "visualize":
            c.add_argument("--frames", required=True, help="Parquet with path and frame_idx")
            c.add_argument("--size", type=int, nargs=2, required=True)
        if name == "validate":
            c.add_argument("--schema", help="JSON schema file; the built-in one unless given")
        if name == "crops":
            c.add_argument("--frames", required=True, help="Parquet with path and frame_idx")
            c.add_argument("--size", type=int, nargs=2, default=(1680, 960))
            c.add_argument("--aspect", type=float, default=2.17)
            c.add_argument("--by", choices=("position", "frame"), default="position")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"shotloom {a.command}").getOrCreate()
    if a.command == "tracks":
        out = tracking.track_summary(tracking.link_tracks(spark.read.parquet(a.input), threshold=a.iou))
    elif a.command == "identities":
        out = pipelines.resolve_identities(spark.read.parquet(a.input), iou=a.iou, local=a.threshold, overall=a.threshold)
    elif a.command == "validate":
        rules = shots.load_schema(spark, a.schema) if a.schema else shots.SCHEMA
        out = pipelines.validate(documents.read_text(spark, a.input), "path", schema=rules)
    elif a.command == "features":
        frames = spark.read.parquet(a.input)
        totals = frames.groupBy("path").agg(F.count("*").cast("int").alias("n_frames"))
        out = pipelines.shot_features(frames, "path", ["frame_idx"], "feature", totals, spark.read.parquet(a.faces), *a.size, threshold=a.threshold)
    elif a.command == "visualize":
        out = pipelines.shot_drawing(spark.read.parquet(a.frames), documents.shots(documents.read_text(spark, a.input), "path"), "path", *a.size)
    else:
        faces = documents.frame_faces(documents.read_text(spark, a.input), "path")
        out = pipelines.crop_plans(faces, spark.read.parquet(a.frames), "path", *a.size, aspect=a.aspect, by=a.by)
    out.write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
