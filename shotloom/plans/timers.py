"""Elapsed time by stage of a flow."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Timers:
    """Adds up the seconds spent in named stages: `with timers("read"): ...`. A stage that fails counts, too."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.calls: dict[str, int] = {}

    @contextmanager
    def __call__(self, stage: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[stage] = self.seconds.get(stage, 0.0) + time.perf_counter() - began
            self.calls[stage] = self.calls.get(stage, 0) + 1

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        """Compute df for its time alone, and return it."""
        with self(stage):
            df.write.format("noop").mode("overwrite").save()
        return df

    def rows(self, spark: SparkSession) -> DataFrame:
        """(stage, calls, seconds), in order of first use."""
        return spark.createDataFrame([(k, self.calls[k], v) for k, v in self.seconds.items()], "stage string, calls int, seconds double")
