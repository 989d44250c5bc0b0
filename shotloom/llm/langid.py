"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel is the blended spectrum of presences: the n-grams (n = 1 to ORDER) of
letters and word bounds that two texts share, over the geometric mean of how
many each has. N-grams are exact: the code points of one fill a long. Of those
in the sample, the SELECTED ones whose presence differs most between languages
span the kernel. Landmarks are sampled texts, evenly from the languages. One
ridge regression for each language (one versus the rest) is fitted in the
Nyström feature space; a batch of texts is scored by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fold, stored, tune

ORDER, SELECTED, LANDMARKS, RIDGE, SHARPNESS = 3, 4096, 128, 1e-2, 4.0
#: About SAMPLE labelled rows are fitted, as many of each language (or all it has), but LEAST of each if there are many languages.
SAMPLE, LEAST = 3000, 12
#: Sampled keys up to which they are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text; whatever isn't a letter is 0, and runs of 0 are one."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]).tolist():
        letter[points == c] = chr(c).isalpha()
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, points, 0)[keep]
    return np.concatenate(([0], out, [0])).astype(np.uint32) if letter.any() else out[:0].astype(np.uint32)


def grams(text: str | None) -> np.ndarray:
    """The text's n-grams, with repeats, as longs: code point + 1 in each 21 bits. Empty without a letter."""
    x = letters(text).astype(np.int64)
    if not len(x):
        return x
    code, out = np.zeros(len(x), np.int64), []
    for n in range(ORDER):
        code = code[: len(x) - n] | (x[n:] + 1) << (21 * n)
        out.append(code)
    return np.concatenate(out)


class Index:
    """Places of the selected (sorted) n-grams, found by a hash without collisions among them."""

    def __init__(self, selected: np.ndarray, bits: int = 22):
        self.selected, self.shift, rng = selected, np.uint64(64 - bits), np.random.default_rng(1)
        while True:
            self.factor = np.uint64(rng.integers(1 << 62, 1 << 63)) * np.uint64(2) + np.uint64(1)
            at = self._slot(selected)
            if len(np.unique(at)) == len(at):
                break
        self.table = np.zeros(1 << bits, np.int16)
        self.table[at] = np.arange(len(selected), dtype=np.int16)

    def _slot(self, found: np.ndarray) -> np.ndarray:
        x = found.view(np.uint64)
        return (((x ^ (x >> np.uint64(29))) * self.factor) >> self.shift).view(np.int64)

    def presence(self, found: np.ndarray) -> np.ndarray:
        """Which of the selected n-grams are among those found."""
        at = self.table[self._slot(found)]
        flags = np.zeros(len(self.selected), bool)
        flags[at[self.selected[at] == found]] = True
        return flags


@dataclass
class Model:
    """langs: classes in order; selected: the n-grams, sorted; marks: landmark presences, normalised; beta: a column for each class."""

    langs: list[str]
    selected: np.ndarray
    marks: np.ndarray
    beta: np.ndarray

    def decide(self, present: np.ndarray) -> np.ndarray:
        """Decision values of a batch: present is texts x selected n-grams."""
        x = present.astype(np.float32)
        norm = np.sqrt(x.sum(1, keepdims=True))
        return (x @ self.marks.T / np.maximum(norm, 1)) @ self.beta


def fit(present: np.ndarray, labels: list[str], selected: np.ndarray) -> Model:
    """Fit on a bounded sample: present is rows x selected n-grams, labels their languages."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels], np.int64)
    x = present.astype(np.float32)
    own = [np.flatnonzero(y == k) for k in range(len(langs))]
    turns = max(map(len, own))
    picked = [rows[i] for i in range(turns) for rows in own if i < len(rows)][: max(LANDMARKS, 2 * len(langs))]
    norm = lambda m: m / np.maximum(np.sqrt(m.sum(1, keepdims=True)), 1)
    marks, unit = norm(x[picked]), norm(x)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = (unit @ marks.T).astype(np.float64) @ root
    weight = 1 / np.bincount(y)[y]  # each language counts the same
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    gram = (phi * weight[:, None]).T @ phi + RIDGE * len(langs) / len(y) * np.eye(phi.shape[1])
    beta = root @ np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
    return Model(langs, selected, marks, beta.astype(np.float32))


def train(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on rows of docs with a language and a letter for which the column `usable` holds; None if there are none.

    Every language is learned, from about sample / languages rows, LEAST at
    least, chosen by a hash of id and text, so that reruns agree and equal rows
    count once. Whole texts become n-grams on the executors. The driver gets the
    SELECTED n-grams and as many bits for each sampled row.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), usable.alias("_use"))
    rows = rows.where("_use and lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"), "text")
    languages = rows.select(F.count_distinct("lang")).head()[0]
    if not languages:
        return None
    each = max(LEAST, -(-sample // languages))
    chosen = rows.select("lang", "key").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("_n") <= each)
    chosen = chosen.select("lang", "key")
    if languages * each <= BROADCAST:
        chosen = F.broadcast(chosen)
    own = rows.join(chosen, ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))
    own = stored(own, "sample")

    def count(batches):
        for b in batches:
            found = [np.unique(grams(t)) for t in b.column(1).to_pylist()]
            of = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, found))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["lang", "gram"])

    sizes = own.groupBy("lang").agg(F.count("*").alias("rows"))
    share = own.select("lang", "text").mapInArrow(count, "lang string, gram long").groupBy("lang", "gram").count().join(sizes, "lang").select("gram", (F.col("count") / F.col("rows")).alias("x"))
    mean = F.sum("x") / languages
    spread = F.sum(F.col("x") * F.col("x")) / languages - mean * mean + F.lit(1e-3) * mean * (1 - mean)
    best = share.groupBy("gram").agg(F.round(spread, 12).alias("spread")).orderBy(F.desc("spread"), "gram").limit(SELECTED).collect()
    selected = np.sort(np.array([r["gram"] for r in best], np.int64))
    if not len(selected):
        return None

    def bits(batches):
        index = Index(selected)
        for b in batches:
            found = [np.packbits(index.presence(grams(t))).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["lang", "key", "bits"])

    got = sorted(own.mapInArrow(bits, "lang string, key long, bits binary").collect(), key=lambda r: (r["key"], r["lang"]))
    discard(own)
    present = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(selected)]
    return fit(present.astype(bool), [r["lang"] for r in got], selected)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """(carried columns, lang_pred, score, margin): one row for each row of docs.

    lang_pred is `und` and score 0 where the text is null, empty or has no letter,
    and everywhere if there is no model. score is the winner's share among the
    languages (softmax of the decision values), margin its decision value: of one
    against the rest, about 1 for a text like those learned, negative for a text
    that every language rejects, null for `und`. Ties go to the first language by
    code point. Texts of any length are read whole.
    """
    tune(docs.sparkSession)
    carried = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(carry, carried)])
    at_text = list(carry).index(text_col) if text_col in carry else len(carry)
    if at_text == len(carry):  # the text moves once, carried or not
        rows = docs.select(*[F.col(c).alias(a) for c, a in zip(carry, carried)], F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        index = Index(model.selected) if model else None
        for b in batches:
            texts = b.column(at_text).to_pylist()
            lang, score, margin = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            for lo in range(0, len(texts) if model else 0, 512):
                found = [(i, grams(texts[i])) for i in range(lo, min(lo + 512, len(texts)))]
                found = [(i, g) for i, g in found if len(g)]
                if found:
                    at = [i for i, _ in found]
                    value = model.decide(np.array([index.presence(g) for _, g in found])).astype(np.float64)
                    best = value.argmax(1)
                    margin[at] = value.max(1)
                    score[at] = 1 / np.exp(SHARPNESS * (value - value.max(1, keepdims=True))).sum(1)
                    for i, k in zip(at, best.tolist()):
                        lang[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], pa.array(lang, pa.string()), pa.array(score), pa.array(margin, from_pandas=True)], [*carried, "lang_pred", "score", "margin"])

    kinds = [f"{a} {rows.schema[a].dataType.simpleString()}" for a in carried]
    out = rows.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, margin double"]))
    return out.select(*[F.col(a).alias(c) for c, a in zip(carry, carried)], "lang_pred", "score", "margin")


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model learns from; a null id is never held out, and never learned from."""
    return F.coalesce(fold(id_col, 4) == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs; learns from the rows that aren't held out.

    An empty table gives an empty result; if no usable row has a language, every
    lang_pred is `und`. Other columns are ignored.
    """
    model = train(docs, ~held_out(id_col), id_col, text_col, lang_col)
    found = predict(docs, model, id_col, text_col, [id_col])
    return found.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "lang_pred", "score")
