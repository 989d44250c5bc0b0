"""Identities of tracks: local ones in a shot, global ones over all shots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import norm
from ..plans.groups import scan_sorted
from ..plans.scratch import appended, discard, numbered, stored
from .graph import connected_components

#: Vectors in a block of the all-pairs comparison; sampled vectors around which they are dealt, at most.
BLOCK, PIVOTS = 2048, 256
#: Bytes of a table of vectors that every worker may hold, and of the vectors that are compared with all others in one scan.
HELD, QUERIES = 64 << 20, 8 << 20


def local_ids(tracks: DataFrame, threshold: float = 0.6, start: int = 0) -> DataFrame:
    """tracks (shot_id, track_ord, first_frame, last_frame, mean, local_id) -> the same with local_id filled.

    First, in order, a track without an id takes that of the most similar track
    that has one and shares no frame with it (the earlier on ties); it then serves
    as a match itself. Then the first track left leads a group: it takes a new id,
    and so do all others left that are similar enough and share no frame with it.
    Tracks without a mean vector only lead. Ids count from start in each shot. A
    shot's tracks, one row each, are taken together.
    """

    def step(rows):
        rows = list(rows)
        given = np.array([r[4] is not None for r in rows])
        mean = np.zeros((len(rows), max((len(r[4]) for r in rows if r[4] is not None), default=0)))
        for i in np.flatnonzero(given):
            mean[i, : len(rows[i][4])] = rows[i][4]
        ids = _local(*(np.array([r[k] for r in rows]) for k in (2, 3)), mean, given, [r[5] for r in rows], threshold, start)
        yield from ((*r[:5], x) for r, x in zip(rows, ids))

    own = tracks.select(F.col("shot_id").cast("long"), F.col("track_ord").cast("long"), F.col("first_frame").cast("int"), F.col("last_frame").cast("int"), F.col("mean").cast("array<double>"), F.col("local_id").cast("int"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own.schema])
    return scan_sorted(own, ["shot_id"], ["track_ord"], step, schema)


#: Tracks of a shot that are compared all at once.
TOGETHER = 512


def _local(first: np.ndarray, last: np.ndarray, mean: np.ndarray, given: np.ndarray, ids: list, threshold: float, start: int) -> list:
    """The ids of one shot's tracks, as local_ids() says."""
    n = len(ids)
    unit = mean / np.where(given, np.linalg.norm(mean, axis=1), 1)[:, None]
    named = np.array([x is not None for x in ids])

    def compared(i):
        """Which tracks are similar to those of i and share no frame with them, and how similar all are."""
        s = unit[i] @ unit.T
        apart = (last < first[i, None]) | (last[i, None] < first)
        return (s >= threshold) & apart & given & given[i, None], s

    whole = compared(np.arange(n)) if n <= TOGETHER else None

    def like(i):
        return tuple(x[i] for x in whole) if whole else tuple(x[0] for x in compared(np.array([i])))

    order, left = np.flatnonzero(named).tolist(), []
    for i in np.flatnonzero(~named).tolist():
        if order:
            fits, s = like(i)
            among = np.array(order, np.int64)
            among = among[fits[among]]
            if len(among):
                ids[i] = ids[among[s[among].argmax()]]
                order.append(i)
                continue
        left.append(i)
    free = np.zeros(n, bool)
    free[left] = True
    for i in left:
        if not free[i]:
            continue
        free[i] = False
        found = np.flatnonzero(like(i)[0] & free)
        for j in found.tolist():
            ids[j] = start
        ids[i] = start
        free[found] = False
        start += 1
    return ids


def local_ids_of(tracks: DataFrame, means: Means, threshold: float = 0.6, start: int = 0, dealt: bool = False) -> DataFrame:
    """local_ids() of tracks (shot_id, track_id, first_frame, last_frame, refs) whose mean vectors are made where they are compared: (shot_id, track_id, refs, local_id)."""

    def step(rows):
        rows = list(rows)
        mean, given = means.of([r[4] for r in rows])
        ids = _local(*(np.array([r[k] for r in rows]) for k in (2, 3)), mean, given, [None] * len(rows), threshold, start)
        yield from ((r[0], r[1], r[4], x) for r, x in zip(rows, ids))

    own = tracks.select(F.col("shot_id").cast("long"), F.col("track_id").cast("int"), F.col("first_frame").cast("int"), F.col("last_frame").cast("int"), "refs")
    schema = T.StructType([T.StructField("shot_id", T.LongType()), T.StructField("track_id", T.IntegerType()), T.StructField("refs", T.ArrayType(T.LongType())), T.StructField("local_id", T.IntegerType())])
    return scan_sorted(own, ["shot_id"], ["track_id"], step, schema, dealt=dealt)


class Means:
    """Mean vectors of lists of references to a table of vectors that every worker holds; references without a vector don't count."""

    def __init__(self, held):
        self.held = held  # a broadcast of sorted numbers and their vectors

    @classmethod
    def over(cls, vectors: DataFrame) -> Means | None:
        """vectors (ref, embedding), refs once each -> their means; None if they take more than HELD bytes or differ in length, or components are missing."""
        spark = vectors.sparkSession
        rows = vectors.where("embedding is not null").select(F.col("ref").cast("long").alias("ref"), F.col("embedding").cast("array<double>").alias("v"))
        missing = F.exists("v", lambda x: x.isNull())
        n, least, most, gaps = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.coalesce(F.max(missing), F.lit(False))).head()
        if not n or least != most or not most or gaps or n * most * 8 > HELD:
            return None
        got = rows.toArrow()
        ref = np.asarray(got["ref"])
        order = ref.argsort()
        flat = np.asarray(got["v"].combine_chunks().flatten()).reshape(n, most)
        return cls(spark.sparkContext.broadcast((ref[order], flat[order])))

    def of(self, lists) -> tuple[np.ndarray, np.ndarray]:
        """A row for each list, and whether it has a mean."""
        n = np.array([len(x) for x in lists], np.int64)
        return self.of_flat(np.array([r for x in lists for r in x], np.int64), n)

    def of_flat(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, v = self.found(flat)
        owner = np.repeat(np.arange(len(n)), n)[at >= 0]
        at = at[at >= 0]
        counts = np.bincount(owner, minlength=len(n))
        given = counts > 0
        out = np.zeros((len(n), v.shape[1]))
        if len(at):
            starts = np.concatenate([[0], np.cumsum(counts[given])[:-1]])
            out[given] = np.add.reduceat(v[at], starts, axis=0) / counts[given, None]
        return out, given

    def found(self, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of references in the vectors, -1 for none, and the vectors."""
        known, v = self.held.value
        at = np.searchsorted(known, refs).clip(max=len(known) - 1)
        return np.where(known[at] == refs, at, -1), v

    def added(self, df: DataFrame) -> DataFrame:
        """df (id, root, refs) -> (id, root, v)."""

        def run(batches):
            for b in batches:
                flat, n = _flat(b.column(2))
                mean, given = self.of_flat(flat, n)
                ends = np.concatenate([[0], np.cumsum(given * mean.shape[1])]).astype(np.int32)
                v = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~given, False)) if not given.all() else pa.array(ends), pa.array(mean[given].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), v], ["id", "root", "v"])

        return df.select("id", "root", "refs").mapInArrow(run, "id long, root long, v array<double>")

    def near(self, df: DataFrame, threshold: float, single: bool) -> DataFrame:
        """df (id, refs) -> (id, ref): the references whose vector is similar to the list's mean."""

        def run(batches):
            for b in batches:
                flat, n = _flat(b.column(1))
                mean, _ = self.of_flat(flat, n)
                at, v = self.found(flat)
                owner = np.repeat(np.arange(len(n)), n)
                owner, at, flat = (x[at >= 0] for x in (owner, at, flat))
                kind = np.float32 if single else np.float64
                s = (_unit(mean).astype(kind)[owner] * _unit(v[at]).astype(kind)).sum(1)
                hit = s >= kind(threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[owner[hit]]), pa.array(flat[hit])], ["id", "ref"])

        return df.select("id", "refs").mapInArrow(run, "id long, ref long")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.flatten()).astype(np.int64), np.asarray(column.value_lengths()).astype(np.int64)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of zeros stay."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def similar_pairs(vectors: DataFrame, threshold: float, single: bool = False, forest: bool = False) -> DataFrame:
    """vectors (id, v) -> (a, b, similarity) for a < b with cosine >= threshold.

    Vectors belong to the nearest of at most PIVOTS sampled ones. A cell's vectors
    lie within its largest angle of the pivot, so two cells whose pivots are too far
    apart, by the triangle inequality of angles, are never compared. Cells are cut
    into blocks of about BLOCK; each pair of blocks left is one task's matrix
    product, and only pairs that reach the threshold leave it - with forest, just
    links that connect what they connect. Null and zero vectors have no pairs.
    single compares in single precision.
    """
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(norm(F.col("v")) > 0)
    total = rows.count()
    few = max(1, min(PIVOTS, -(-total // BLOCK)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(few).toArrow() if few > 1 else None
    pivots = _unit_rows(drawn.column("v")) if drawn is not None else None

    def cells(batches):
        for b in batches:
            cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            if pivots is not None:
                s = _unit_rows(b.column(1), pivots.shape[1]) @ pivots.T
                cell = s.argmax(1).astype(np.int32)
                angle = np.arccos(np.clip(s.max(1), -1, 1)) if len(s) else angle
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], ["id", "v", "cell", "angle"])

    dealt = rows.mapInArrow(cells, "id long, v array<double>, cell int, angle double")
    dealt = stored(dealt, "cells") if few > 1 else dealt
    size, reach = {0: total}, {0: 0.0}
    if few > 1:
        for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect():  # at most PIVOTS rows
            size[r["cell"]], reach[r["cell"]] = r["n"], r["reach"]
    far = np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    blocks = {c: max(1, -(-n // BLOCK)) for c, n in size.items()}
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if few > 1 else np.zeros((1, 1))
    near = {c: sorted(d for d in size if c == d or apart[c, d] - reach[c] - reach[d] <= far) for c in size}
    # for each cell, its blocks and those of the cells in reach: bounded by PIVOTS, not by the vectors
    reachable = F.create_map(*[x for c in size for x in (F.lit(c), F.array(*[F.struct(F.lit(d).alias("cell"), F.lit(blocks[d]).alias("blocks")) for d in near[c]]))])
    own = dealt.withColumn("_near", reachable[F.col("cell")]).withColumn("_own", F.filter("_near", lambda x: x["cell"] == F.col("cell"))[0]["blocks"])
    own = own.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_own").cast("long")).cast("int"))
    mine = F.struct(F.col("cell").alias("cell"), F.col("_b").alias("b"))
    other = F.explode(F.flatten(F.transform("_near", lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: F.struct(x["cell"].alias("cell"), k.alias("b"))))))
    sent = own.select("id", "v", mine.alias("mine"), other.alias("other")).select("id", "v", (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") == F.col("other")).alias("same"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ids, left, same = np.asarray(table["id"]), np.asarray(table["left"]), table["same"][0].as_py()
        m = _unit_rows(table["v"])
        m = m.astype(np.float32) if single else m
        x, y = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        s = m[x] @ m[y].T
        i, j = np.nonzero(s >= (np.float32(threshold) if single else threshold))
        i, j, value = x[i], y[j], s[i, j].astype(np.float64)
        keep = ids[i] < ids[j] if same else ids[i] != ids[j]
        i, j, value = i[keep], j[keep], value[keep]
        if forest:
            keep = _spanning(len(ids), i, j)
            i, j, value = i[keep], j[keep], value[keep]
        return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "similarity": value})

    return sent.groupBy("i", "j").applyInArrow(compare, "a long, b long, similarity double")


def _unit_rows(column, width: int | None = None) -> np.ndarray:
    """A list column's vectors as rows of length 1; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten())
    width = max(width or 0, int(n.max()) if len(n) else 0)
    if len(flat) == len(n) * width:
        m = flat.reshape(len(n), width)
    else:
        m = np.zeros((len(n), width))
        m[np.arange(width) < n[:, None]] = flat
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links a spanning forest keeps."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def components(rows: DataFrame, threshold: float, single: bool = False, links: DataFrame | None = None, means: Means | None = None) -> DataFrame:
    """rows (id, v), or (id, refs) with means -> (node, root): components of similar vectors, for every id; root is the smallest id.

    Blocks of vectors are compared with all others, one scan for each block, so
    that no copies of vectors are written. links (u, v) are known to be similar.
    Vectors of the largest component known so far need not be asked about each
    other: all others are asked about everything. If they are many, a first block
    of them tells more of the components. Vectors are compared with those of a
    block around a pivot only if they may reach them by the triangle inequality.
    """
    vectors = means.added if means else lambda df: df.select("id", "root", "v")
    usable = lambda df: vectors(df).where(norm(F.col("v")) > 0)
    plain = rows.withColumn("root", F.col("id"))
    total = rows.count()
    few = max(1, min(PIVOTS, -(-total // BLOCK)))
    # a few more than are wanted: some may have no usable vector
    pivots = usable(plain.orderBy(F.xxhash64("id"), "id").limit(few + 64)).limit(few).toArrow().column("v")
    pivots = _unit_rows(pivots) if len(pivots) else np.zeros((1, 1))
    per = max(1, QUERIES // (8 * max(1, pivots.shape[1])))
    far = np.arccos(np.clip(threshold, -1, 1)) + 1e-6

    def labelled(known: DataFrame) -> DataFrame:
        root = known.select(F.col("node").alias("id"), "root")
        return stored(rows.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")), "labelled", free=True)

    def outside(df: DataFrame):
        """Whether a row isn't of the largest component, and how many aren't."""
        top = df.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1).collect()
        if not top or top[0]["count"] == 1:
            return F.lit(True), total
        return F.col("root") != top[0]["root"], total - top[0]["count"]

    def block(count: int, seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")

    def scan(df: DataFrame, asked: DataFrame) -> tuple[DataFrame, Broadcast | None]:
        """(u, v): roots of similar vectors, a forest for each batch; and what to destroy once they are written."""
        q = usable(asked).select("root", "v").toArrow()
        sent = None
        if q.num_rows:
            own, unit = np.asarray(q["root"]), _unit_rows(q["v"])
            d = min(unit.shape[1], pivots.shape[1])
            angle = np.arccos(np.clip(unit[:, :d] @ pivots[:, :d].T, -1, 1))
            cell = angle.argmin(1)
            cells = [(c, at, angle[at, c].max()) for c in np.unique(cell) for at in [np.flatnonzero(cell == c)]]
            unit = unit.astype(np.float32) if single else unit
            sent = df.sparkSession.sparkContext.broadcast((own, unit, cells))
        at_least = np.float32(threshold) if single else threshold

        def run(batches):
            for b in batches:
                if sent is None or not b.num_rows:
                    continue
                own, unit, cells = sent.value
                root, m = np.asarray(b.column(1)), _unit_rows(b.column(2))
                d = min(m.shape[1], pivots.shape[1])
                angle = np.arccos(np.clip(m[:, :d] @ pivots[:, :d].T, -1, 1)) if len(cells) > 1 else None
                m = m.astype(np.float32) if single else m
                d = min(m.shape[1], unit.shape[1])
                u, v = [], []
                for c, at, reach in cells:
                    near = np.arange(len(m)) if angle is None else np.flatnonzero(~(angle[:, c] - reach > far))
                    target, other = unit[at, :d].T, own[at]
                    step = max(1, (4 << 20) // len(at))
                    for k in range(0, len(near), step):
                        i, j = np.nonzero(m[near[k : k + step], :d] @ target >= at_least)
                        i = root[near[k : k + step][i]]
                        j = other[j]
                        differ = i != j
                        if differ.any():
                            pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1)[differ], axis=0)
                            u.append(pairs[:, 0])
                            v.append(pairs[:, 1])
                if u:
                    u, v = np.concatenate(u), np.concatenate(v)
                    names, x = np.unique(np.concatenate([u, v]), return_inverse=True)
                    keep = _spanning(len(names), x[: len(u)], x[len(u) :])
                    yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

        return usable(df).mapInArrow(run, "u long, v long"), sent

    def scans(count: int, rest, mine):
        # a block's vectors meet those of the blocks before it no more
        for k in range(count):
            found, sent = scan(now.where(~(rest & (mine < k))), now.where(rest & (mine == k)))
            yield found
            if sent:
                sent.destroy()

    now = plain if links is None else labelled(connected_components(links))
    rest, left = (F.lit(True), total) if links is None else outside(now)
    if left > 2 * per:
        found, sent = scan(now, now.where(rest & (block(-(-left // per), 1) == 0)))
        before, now = now, labelled(connected_components(found if links is None else found.unionByName(links.select("u", "v"))))
        discard(before)
        if sent:
            sent.destroy()
        rest, left = outside(now)
    blocks = -(-left // per)
    found = appended(scans(blocks, rest, block(max(1, blocks), 2)), "links")
    named = now.select(F.col("id").alias("node"), "root")
    if found is None:
        return named
    joined = connected_components(found).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return named.join(joined, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))


def global_ids(vectors: DataFrame, threshold: float = 0.7, start: int = 0, single: bool = False) -> DataFrame:
    """vectors (id, v) -> (id, global_id): components of similar vectors, numbered by their smallest id.

    Rows without a usable vector get numbers of their own after all components,
    in order of id.
    """
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    linked = stored(components(rows, threshold, single), "linked")
    has = F.coalesce(norm(F.col("v")) > 0, F.lit(False))
    roots = rows.select("id", has.alias("has")).join(linked, F.col("id") == F.col("node"), "left").select("id", F.when(F.col("has"), F.coalesce("root", "id")).alias("root"))
    return _numbered(roots, start)


def _numbered(roots: DataFrame, start: int) -> DataFrame:
    """(id, ..., root) -> the same with global_id for root: by root, then those without one by id."""
    of = F.struct(F.col("root").isNull().alias("none"), F.coalesce("root", "id").alias("root"))
    roots = roots.withColumn("of", of)
    return roots.join(numbered(roots, "of", "global_id", start), "of").drop("of", "root")


def global_ids_of(tracks: DataFrame, means: Means, threshold: float = 0.7, start: int = 0, single: bool = False) -> DataFrame:
    """global_ids() of tracks (id, refs, ...) whose vectors are the means of what refs name; other columns stay, refs goes.

    Tracks of the same refs are one vector, which bears the smallest id of them.
    The vector of one reference is like the means that hold it, if it is similar
    enough; these links come first.
    """
    lists = stored(tracks.where(F.size("refs") > 0).groupBy("refs").agg(F.min("id").alias("id")).select("id", "refs"), "lists", free=True)
    alone = lists.where(F.size("refs") == 1).select(F.col("id").alias("v"), F.col("refs")[0].alias("ref"))
    links = stored(means.near(lists.where(F.size("refs") > 1), threshold, single).join(alone, "ref").select(F.col("id").alias("u"), "v").distinct(), "links", free=True)
    linked = components(lists, threshold, single, links, means)
    fine = means.added(lists.withColumn("root", F.col("id"))).where(norm(F.col("v")) > 0).select(F.col("id").alias("node"))
    linked = linked.join(fine, "node").join(lists.withColumnRenamed("id", "node"), "node").select("refs", "root")
    linked = stored(linked, "linked", free=True)
    return _numbered(stored(tracks.join(linked, "refs", "left").drop("refs"), "named", free=True), start)
