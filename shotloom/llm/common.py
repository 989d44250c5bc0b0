"""Shared plumbing of the training-data operators: batch sizes, folds, hashing; scratch tables are the engine's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import discard, stored

__all__ = ["discard", "fold", "mix64", "shuffle_parts", "stored", "tune"]

#: Arrow batches handed to Python are bounded in rows and in bytes, so that a
#: partition of very long texts never becomes one batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (both settings are runtime SQL settings)."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col, folds: int):
    """crc32 of the id as text modulo the number of folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place) so that their order and low bits are well mixed."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
