"""From raw documents to token ids: language filter, near duplicates, repeated passages, source mix, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.llm import bpe, common, langid, mixing, simhash, substrings
from shotloom.plans import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHORT = 40
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


_before = (0, 0)


def frugal(stage):
    """The stage, begun by deleting the scratch tables of the stage before it: its result, which docs is read from, is written."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _before
        scratch.sweep(*_before, docs)
        first = scratch.mark()
        found = stage(spark, docs, sf_dir)
        _before = (first, scratch.mark())
        return found

    return run_stage


@frugal
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; lang becomes the predicted one.

    Rejects texts without a letter, and texts that every language's regression
    rejects (no positive margin), but for those of under SHORT characters, which
    are too short to tell. The model learns from the rows of docs that have a lang
    and aren't held out; without any, letters decide and lang stays.
    """
    model = langid.train(docs, ~langid.held_out())
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = langid.predict(docs, model, carry=COLUMNS).where("lang_pred <> 'und'")
    found = found.where((F.col("margin") > 0) | (F.char_length("text") < SHORT))
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


@frugal
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id, null ids last.

    Near copies have 80 hundredths or more of their five-word shingles in common
    (Jaccard). Rows with one id but different texts are documents of their own;
    of rows with equal id and text, the one with the smallest source, lang and
    n_chars (nulls first) stays.
    """
    keep = simhash.simhash_groups(docs, shingle=5, percent=80).where("node = first").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = [F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    names = ["nil", "id", "node"]
    keep = keep.select(*key, "node").distinct()
    rest = F.struct("source", "lang", "n_chars")
    rows = docs.select(*key, F.xxhash64("text").alias("node"), "text", rest.alias("rest"))
    rows = rows.groupBy(*names).agg(F.first("text").alias("text"), F.min("rest").alias("rest"))
    kept = rows.join(keep, names, "left_semi")
    return kept.select(F.when(~F.col("nil"), F.col("id")).alias("doc_id"), "text", "rest.*").select(COLUMNS)


@frugal
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 20 words or more that occur earlier; a document of which nothing is left goes."""
    found = substrings.dedup_substrings(docs, carry=["lang", "source"], layout=True)
    found = found.where("n_removed = 0 or n_removed < n_words").withColumnRenamed("kept", "text")
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


@frugal
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as its source's share takes it; one a source may end early.

    The rows come sorted by range of training position; written as Parquet, part
    numbers and rows keep that order, which encode() turns into a column.
    Null and empty texts have no words and are never taken.
    """
    plan = mixing.curriculum(mixing.mix(docs, carry=["text", "lang", "n_chars"]))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    cut = F.array_join(F.slice(words, 1, F.col("words").cast("int")), " ")
    whole = F.col("words") == F.col("size")
    text = F.when(whole, F.col("text")).otherwise(cut)
    return plan.withColumn("text", text).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text")).cast("long")).select(COLUMNS)


@frugal
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: position, doc_id, n_tokens, ids and digests of the ids and of the text they decode to.

    position is the place of the row in docs, as the stage before wrote it: its
    sort order is the order of training, and a document's passes follow by it.
    """
    import public_tokenizers

    rows = placed(docs).withColumn("key", F.struct("position", "doc_id"))
    found = bpe.bpe(rows, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, id_col="key").drop("decoded")
    return found.select("doc_id.position", "doc_id.doc_id", *found.columns[1:])


def placed(docs: DataFrame) -> DataFrame:
    """docs with position: number of the Parquet part and row in it; rows that come from no file are numbered as they come."""
    try:
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).try_cast("long")
        return docs.withColumn("position", F.coalesce(part, F.lit(0)) * (1 << 33) + F.col("_metadata.row_index"))
    except AnalysisException:
        return docs.withColumn("position", F.monotonically_increasing_id())


STAGES = [
    ("language ID", language),
    ("near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("byte-level BPE", encode),
]

#: Language ID and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again (Parquet files, so that the next stage can clean up)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.stored(stage(spark, docs, sf_dir), f"stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
