"""Sequential operators over sorted rows: one pass, state in proportion to what is open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scan_sorted(df: DataFrame, keys: list[str], order: list, step: Callable[[Iterator[tuple]], Iterator[tuple]], schema: StructType, parts: int | None = None, dealt: bool = False) -> DataFrame:
    """Run step over each group's rows in order; groups never meet in memory as a whole.

    Rows are dealt by keys and sorted in the JVM. step gets an iterator over one
    group's rows (tuples in df's column order) and yields tuples of schema.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [df.columns.index(k) for k in keys]
    arrow = to_arrow_schema(schema)

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held = next(rows, None)
        out: list[tuple] = []
        while held is not None:
            key = tuple(held[i] for i in at)

            def group(first):
                nonlocal held
                while first is not None and tuple(first[i] for i in at) == key:
                    yield first
                    first = held = next(rows, None)

            source = group(held)
            for cells in step(source):
                out.append(cells)
                if len(out) >= 4096:
                    yield _batch(out, arrow)
                    out = []
            for _ in source:  # what step left
                pass
        if out:
            yield _batch(out, arrow)

    return (df if dealt else df.repartition(n, *keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
