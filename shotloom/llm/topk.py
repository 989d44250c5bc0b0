"""Exact top-k inner products by distributed histogram selection.

Queries are taken in blocks of BLOCK; a block is bounded, so it travels with the
tasks. In each round every candidate is scored; a partition reports counts of
the scores in BINS equal bins of each query's open range, from the top and only
as far down as it needs for k. The sums locate the bin of the k-th score, which
is the next round's range, until a range is a single score. A last pass keeps
what lies above, and of the ties the smallest ids.

Scores are 64-bit integers; ranges are taken over their order as unsigned keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import appended
from .common import stored, tune

BLOCK, BINS, CHUNK = 4096, 1024, 2048
#: One more than the largest score and component.
LIMIT = 1 << 63
_SIGN = np.uint64(LIMIT)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component as double; rows with a null id or vector, or null or non-finite components, are left out.

    A value that a long can't hold fails.
    """
    x = F.col("v")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    wide = F.raise_error(F.lit("a quantised component leaves 64 bits")).cast("long")
    scaled = lambda c: F.lit(float(scale)) * c
    whole = F.transform(x, lambda c: F.when((scaled(c) >= -float(LIMIT)) & (scaled(c) < float(LIMIT)), F.floor(scaled(c))).otherwise(wide))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select("vec_id", whole.alias("q"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = np.asarray(column.flatten()), np.asarray(column.value_lengths()).astype(np.int64)
    if len(flat) == len(ends) * width:
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def _scored(queries: np.ndarray, kind):
    """A function from candidates, and which pairs count, to integer scores (queries x candidates).

    In floating point they are exact by the caller's bound. In 64-bit integers
    sums wrap, which is right for every score that fits: whether it does is seen
    from the sum in floating point and its error bound, and from Python's
    integers where that leaves it open. A score that doesn't fit fails.
    """
    q = queries.astype(kind)
    if kind is not np.int64:
        return lambda m, counts: (q @ m.astype(kind).T).astype(np.int64)
    about = queries.astype(np.float64)

    def score(m, counts):
        other = m.astype(np.float64)
        error = (np.abs(about) @ np.abs(other).T) * (2.0**-50 * max(1, q.shape[1]))
        out = q @ m.T
        for i, j in np.argwhere(counts & (np.abs(about @ other.T) + error >= float(LIMIT))):
            value = sum(a * b for a, b in zip(q[i].tolist(), m[j].tolist()))
            if not -LIMIT <= value < LIMIT:
                raise OverflowError("a score leaves 64 bits")
            out[i, j] = value
        return out

    return score


def _keys(scores: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the scores."""
    return scores.view(np.uint64) ^ _SIGN


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by the inner product of floor(scale * x).

    is_query is a column over vec_id. Every row but the query's own id is a
    candidate; ties go to the smaller id; fewer than k candidates are all
    returned. Ids are expected to be unique: rows that share one are candidates
    each, and are one query by their smallest vector. Vectors of different
    lengths are compared as if the shorter ended in zeros. Without usable rows
    the result is empty. Other columns are ignored. Scores are exact for all
    values in 64 bits; a component or a score beyond them fails.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = stored(quantised(vectors, id_col, vec_col, scale), "vectors")
    # the bounds that the arithmetic and the first ranges need
    norm2 = F.aggregate("q", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    top = F.array_max(F.transform("q", lambda c: F.abs(c.cast("double"))))
    width, most, longest, n = rows.agg(F.max(F.size("q")), F.max(top), F.max(F.sqrt(norm2)), F.count("*")).head()
    width = width or 0
    bound = float(width) * float(most or 0) ** 2
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    asked = stored(rows.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    id_kind = rows.schema["vec_id"].dataType.simpleString()

    def blocks():
        after = None
        while n:
            # the next block of queries by id: bounded, so it may go to the driver
            block = (asked if after is None else asked.where(F.col("vec_id") > after)).orderBy("vec_id").limit(BLOCK).toArrow()
            if not block.num_rows:
                break
            ids = np.asarray(block.column("vec_id"))
            after = ids[-1].item()
            yield _block(rows, ids, _matrix(block.column("q"), width), k, width, kind, float(longest or 0), id_kind)

    done = appended(blocks(), "best")
    if done is None:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, width: int, kind, longest: float, id_kind: str) -> DataFrame:
    reach = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * longest * (1 + 1e-9) + 1
    reach = np.array([min(LIMIT - 1, math.ceil(x)) for x in reach.tolist()], np.int64)
    low, top = _keys(-reach - 1), _keys(reach)  # the k-th score's key lies in [low, top]
    above = np.zeros(len(ids), np.int64)  # candidates that score over top
    bins = np.uint64(BINS)
    while (top > low).any():
        step = (top - low) // bins + np.uint64(1)

        def count(batches, low=low, top=top, step=step, above=above):
            score = _scored(q, kind)
            total = np.zeros(len(ids) * BINS, np.int64)
            any_rows = False
            for b in batches:
                own, m = np.asarray(b.column(0)), _matrix(b.column(1), width)
                for at in range(0, len(own), CHUNK):
                    any_rows = True
                    other = own[at : at + CHUNK][None, :] != ids[:, None]
                    s = _keys(score(m[at : at + CHUNK], other))
                    use = (s >= low[:, None]) & (s <= top[:, None]) & other
                    r, c = np.nonzero(use)
                    bin_ = ((s[r, c] - low[r]) // step[r]).astype(np.int64)
                    total += np.bincount(r * BINS + bin_, minlength=len(total))
            if any_rows:
                t = total.reshape(len(ids), BINS)
                over = np.cumsum(t[:, ::-1], 1)[:, ::-1] - t  # in this partition, in higher bins
                r, c = np.nonzero((t > 0) & (over < (k - above)[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(t[r, c])], ["r", "bin", "n"])

        found = rows.mapInArrow(count, "r int, bin int, n long").groupBy("r", "bin").agg(F.sum("n").alias("n"))
        # the first bin from the top where the counts reach k, or the lowest: one row for each query
        run = Window.partitionBy("r").orderBy(F.desc("bin"))
        need = F.element_at(F.lit((k - above).tolist()), F.col("r") + 1)
        reached = found.withColumn("over", F.sum("n").over(run) - F.col("n")).where(F.col("over") < need)
        got = reached.groupBy("r").agg(F.min_by(F.struct("bin", "over", "n"), "bin").alias("x")).select("r", "x.*").toArrow()
        r, bin_, over, inside = (np.asarray(got.column(c)).astype(np.int64) for c in ("r", "bin", "over", "n"))
        few = above[r] + over + inside < k  # fewer candidates than k: everything is wanted
        new_low, new_top = low.copy(), low.copy()  # a query without candidates closes at its lowest score
        start = low[r] + bin_.astype(np.uint64) * step[r]
        new_low[r], new_top[r] = start, start + np.minimum(top[r] - start, step[r] - np.uint64(1))
        new_low[r[few]] = new_top[r[few]] = low[r[few]]
        above[r[~few]] += over[~few]
        above[r[few]] += (over + inside)[few]
        low, top = new_low, new_top
    cut = (low ^ _SIGN).view(np.int64)

    def keep(batches):
        score = _scored(q, kind)
        ties: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            own, m = np.asarray(b.column(0)), _matrix(b.column(1), width)
            for at in range(0, len(own), CHUNK):
                mine = own[at : at + CHUNK]
                other = mine[None, :] != ids[:, None]
                s = score(m[at : at + CHUNK], other)
                r, c = np.nonzero((s > cut[:, None]) & other)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(mine[c]), pa.array(s[r, c])], ["query_id", "vec_id", "score"])
                r, c = np.nonzero((s == cut[:, None]) & other)
                ties.append((r, mine[c]))
            if ties:  # of this partition's ties, the smallest ids suffice
                r, v = (np.concatenate(x) for x in zip(*ties))
                order = np.lexsort((v, r))
                r, v = r[order], v[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < (k - above)[r]
                ties = [(r[first], v[first])]
        if ties:
            r, v = ties[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(v), pa.array(cut[r])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(keep, f"query_id {id_kind}, vec_id {id_kind}, score long")
