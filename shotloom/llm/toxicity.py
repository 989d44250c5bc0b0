"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes. The
features of a text are the presences of its words, word pairs and pairs that
skip one word, hashed into 2**BITS slots. Per-coordinate learning rates and an
L1 penalty leave a sparse weight vector, which travels with the tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, tune

BITS = 20
#: At most so many labelled rows of each class are fitted, and of these, in order of a hash, at most so many feature slots in all.
SAMPLE, SLOTS = 4000, 40_000_000
#: A prediction is 1 from this score.
THRESHOLD = 0.7
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def slots(text: str | None) -> np.ndarray:
    """The text's feature slots, with repeats."""
    words = _WORDS(text.lower().encode("utf-8", "replace")) if text else []
    if not words:
        return np.zeros(0, np.int32)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    pair = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
    skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] + np.uint64(1)
    x = np.concatenate((h, pair, skip))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Settings:
    """Of FTRL-proximal; the defaults are cross_validated()'s choice among CANDIDATES on the learnable rows of the tables (README)."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.001
    epochs: int = 8


CANDIDATES = tuple(Settings(alpha=a, l1=p, epochs=e) for a in (0.5, 1.0, 2.0) for p in (2.0, 4.0, 8.0) for e in (2, 4, 8))


@dataclass
class Weights:
    """Non-zero weights at slots (sorted), and the intercept."""

    slots: np.ndarray
    values: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.slots] = self.values
        return w


def ftrl(rows: list[np.ndarray], labels: list[int], settings: Settings = Settings(), seed: int = 7) -> Weights:
    """Fit on rows of distinct slots. The intercept is an unpenalised feature of its own."""
    size, s = 1 << BITS, settings
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)

    def weights(at):
        zz = z[at]
        rate = (s.beta + np.sqrt(n[at])) / s.alpha + s.l2
        free = at == size
        w = -(zz - np.where(free, 0, np.sign(zz) * s.l1)) / rate
        w[(np.abs(zz) <= s.l1) & ~free] = 0
        return w

    rows = [np.append(r, size).astype(np.int64) for r in rows]
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - labels[i]
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    found = np.flatnonzero(w[:size])
    return Weights(found.astype(np.int32), w[found].astype(np.float32), float(w[size]))


def cross_validated(rows: list[np.ndarray], labels: list[int], folds: int = 4, candidates: tuple[Settings, ...] = CANDIDATES) -> list[tuple[int, float, Settings]]:
    """(wrong predictions, mean log loss) on the folds left out, and the settings, best first; row i is in fold i modulo folds."""
    out = []
    for c in candidates:
        wrong, loss = 0, 0.0
        for f in range(folds):
            rest = [i for i in range(len(rows)) if i % folds != f]
            w = ftrl([rows[i] for i in rest], [labels[i] for i in rest], c)
            dense = w.dense()
            for i in range(f, len(rows), folds):
                x = max(-35.0, min(35.0, float(dense[rows[i]].sum()) + w.intercept))
                loss += math.log1p(math.exp(-x if labels[i] else x))
                wrong += (1 / (1 + math.exp(-x)) >= THRESHOLD) != bool(labels[i])
        out.append((wrong, loss / max(1, len(rows)), c))
    return sorted(out, key=lambda x: x[:2])


def sampled(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(key, doc_id, y, slots): distinct feature slots of at most `sample` labelled documents of each class, chosen by a hash of their id."""
    tune(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).where(usable)
    marks = marks.select("doc_id", (F.col("y") == 1).cast("int").alias("y"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")).alias("key"))
    chosen = [marks.where(F.col("y") == c).orderBy("key", "doc_id").limit(sample) for c in (0, 1)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = rows.groupBy("key", "doc_id", "y").agg(F.min("text").alias("text"))  # one text of an id

    def run(batches):
        for b in batches:
            found = [np.unique(slots(t)) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["key", "doc_id", "y", "slots"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"key long, doc_id {kind}, y int, slots array<int>")


def train(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, settings: Settings = Settings()) -> Weights:
    """Fit on at most `sample` labelled documents of each class and SLOTS feature slots, chosen by a hash of their id.

    usable is a column over the id. A document labelled twice counts as toxic if
    one label says so; null labels and ids are ignored. Of documents that share an
    id one counts, the one with the smallest text. One task of an executor fits
    the sample; the driver gets the weights that the L1 penalty leaves. Without
    labelled rows the weights are empty and every score is 1/2.
    """
    most = SLOTS

    def fit(batches):
        x, y, total = [], [], 0
        for b in batches:
            for row, label in zip(b.column(3), b.column(2).to_pylist()):
                own = np.asarray(row.values)
                total += len(own)
                if total > most:
                    break
                x.append(own)
                y.append(label)
        if y:
            w = ftrl(x, y, settings)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(w.slots, -1).astype(np.int32)), pa.array(np.append(w.values.astype(np.float64), w.intercept))], ["slot", "weight"])

    rows = sampled(docs, labels, usable, id_col, text_col, label_col, sample)
    got = rows.repartition(1).sortWithinPartitions("key", "doc_id").mapInArrow(fit, "slot int, weight double").toArrow()
    at, w = np.asarray(got.column("slot")), np.asarray(got.column("weight"))
    return Weights(at[at >= 0], w[at >= 0].astype(np.float32), float(w[at < 0].sum()))


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 for each row of docs; null and empty texts get the intercept's."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        dense = weights.dense()
        for b in batches:
            out = np.zeros(b.num_rows)
            for i, t in enumerate(b.column(1).to_pylist()):
                at = slots(t)
                at = np.unique(at[dense[at] != 0])
                out[i] = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(dense[at].sum()) + weights.intercept))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels no model learns; a null id is never held out, and never learned from."""
    return F.coalesce(fold(id_col, 3) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; predicted is 1 from THRESHOLD.

    Null and empty texts get the intercept's score, equal texts equal scores;
    texts of any length are read whole. An empty table gives an empty result; columns of either table that aren't named are ignored.
    """
    weights = train(docs, labels, ~held_out("doc_id"), id_col, text_col, label_col)
    found = score(docs, weights, id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
