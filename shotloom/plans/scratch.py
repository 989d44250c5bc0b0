"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where the shared folder is a mounted file system, scratch files get no checksum files beside them: Hadoop starts a process for each file that it creates there. Other file systems ignore this.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


#: Scratch paths of this process, with the time at which each was begun.
_BEGUN: list[tuple[float, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that no other table has."""
    path = f"{shared_dir(spark)}/shotloom/{name}-{uuid.uuid4().hex}"
    _BEGUN.append((time.time(), path))
    return path


def mark() -> int:
    """How many scratch tables were begun so far."""
    return len(_BEGUN)


def sweep(first: int, last: int, written: DataFrame) -> None:
    """Delete the scratch tables from number first to before last, if `written` was read from files that are all younger: what needed the tables is in them."""
    found = written.inputFiles()
    if not found or first == last:
        return
    spark = written.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    place = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f)
    age = place(found[0]).getFileSystem(conf).getFileStatus(place(found[0])).getModificationTime() / 1000
    if age >= max(t for t, _ in _BEGUN[first:last]):
        for _, path in _BEGUN[first:last]:
            if not any(path.rsplit("/", 1)[1] in f for f in found):
                place(path).getFileSystem(conf).delete(place(path), True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="shotloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """df written as Parquet below the shared folder and read again: lineage ends there, lost executors don't matter.

    With free, the shuffle files of what has ended are given back at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**PLAIN).parquet(path)
    if free:
        free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete shuffle files that no plan refers to: it learns of them when the driver collects its garbage, which may be long after."""
    for _ in range(2):  # what the first finds may hold on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.15)


def bucketed(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """df written once as a table of `parts` buckets by key, in the shared folder: joins by key move the other side only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "shotloom_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(parts, key).write.bucketBy(parts, key).options(path=path, **PLAIN).format("parquet").saveAsTable(table)
    free_shuffles(spark)
    out = spark.table(table)
    out._stored_at = path
    return out


def appended(parts: Iterable[DataFrame], name: str) -> DataFrame | None:
    """Parts written one after the other to one table and read as one scan; None without parts."""
    path, first = None, None
    for part in parts:
        path = path or new_path(part.sparkSession, name)
        first = part if first is None else first
        part.write.mode("append").options(**PLAIN).parquet(path)
    if first is None:
        return None
    out = first.sparkSession.read.schema(first.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def numbered(df: DataFrame, column: str, number: str, start: int = 0) -> DataFrame:
    """Distinct values of a column with their rank, without one task that sees them all.

    Values are sorted by range; a partition's numbers start after the counts of
    those before it, one row for each partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(column).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranks")
    total, before = start, []
    for r in sorted(ranged.groupBy("_part").count().collect()):
        before.append((r["_part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return ranged.join(F.broadcast(offsets), "_part").select(column, (F.col("_before") + F.col("_at")).alias(number))
