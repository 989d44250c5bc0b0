"""SimHash near-duplicates: exact links within a Hamming radius, found with vantage-point trees.

Fingerprints that are equal collapse to one row first. A small tree, built on a
bounded sample, cuts the Hamming space into shards: every fingerprint has one
home shard, and is also sent as a visitor to the shards that the triangle
inequality leaves open. While shards are too large, each is cut again by a tree
of its own. Each shard is searched by a vantage-point tree, and reports a
spanning forest of its links, never all pairs of a dense group. Components of
the forest are joined up by connected_components().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import shuffle_parts, stored, tune

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Distinct fingerprints aimed at in a shard; depth of one dealing tree at most (deeper trees are dealt level by level); sample rows for each of its leaves.
SHARD, LEVEL, SAMPLE = 8192, 12, 64
LEAF, BLOCK = 64, 1 << 21


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, each as often as it occurs.

    A-Z are lower-cased; words are runs without ASCII white space. A text with
    fewer words than a shingle is one shingle; a text without words (null, empty,
    blank) gives 0. A bit is 1 if it is set in more than half of the hashes.
    """
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of docs, fp as a signed long."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def build_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete binary tree in heap order; radius -1 marks a node that isn't split."""
    points, radii = np.zeros(2**depth, np.uint64), np.full(2**depth, -1, np.int64)
    todo = [(1, sample)]
    while todo:
        node, own = todo.pop()
        if node >= 2**depth or len(own) < 2:
            continue
        best = None
        for v in own[:: max(1, len(own) // 5)][:5]:
            d = np.bitwise_count(own ^ v).astype(np.int64)
            for mu in {int(np.median(d)), int(np.median(d)) - 1}:
                uneven = abs(int((d <= mu).sum()) * 2 - len(own))
                if 0 < (d <= mu).sum() < len(own) and (best is None or uneven < best[0]):
                    best = (uneven, v, mu, d)
        if best:
            _, points[node], radii[node], d = best
            todo += [(2 * node, own[d <= radii[node]]), (2 * node + 1, own[d > radii[node]])]
    return points, radii


def route(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], radius: int, visitors: bool = False):
    """Yield (shard, positions, is home): one home for each fingerprint, and every shard that may hold a partner.

    Of two partners that a node parts, the inner one visits the outer side.
    Fingerprints that are visitors have no home and visit every side in reach.
    """
    points, radii = tree
    every, none = np.arange(len(fps)), np.arange(0)
    todo = [(1, none, every) if visitors else (1, every, none)]
    while todo:
        node, home, visit = todo.pop()
        if not len(home) + len(visit):
            continue
        if node >= len(points) or radii[node] < 0:
            yield node, home, True
            yield node, visit, False
            continue
        mu = radii[node]
        dh, dv = (np.bitwise_count(fps[x] ^ points[node]).astype(np.int64) for x in (home, visit))
        todo.append((2 * node, home[dh <= mu], visit[dv - radius <= mu]))
        todo.append((2 * node + 1, home[dh > mu], np.concatenate((home[(dh <= mu) & (dh + radius > mu)], visit[dv + radius > mu]))))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position linked to each of n positions."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def search(home: np.ndarray, visit: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (from, to) between home points, and between visitors and home points, within radius."""
    fps = np.concatenate((home, visit))
    a, b, kept = [], [], 0
    todo = [(np.arange(len(home)), np.arange(len(home), len(fps)))]

    def squeeze():
        label = forest(len(fps), np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return [moved], [label[moved]]

    while todo:
        h, v = todo.pop()
        if not len(h) or len(h) == 1 and not len(v):
            continue
        cut = None
        if len(h) > LEAF:
            for point in fps[h[:: len(h) // 4][:4]]:
                d = np.bitwise_count(fps[h] ^ point).astype(np.int64)
                mu = int(np.median(d))
                mu -= int((d <= mu).all())
                if (d <= mu).any():
                    cut = (point, mu, d)
                    break
        if cut:
            point, mu, d = cut
            dv = np.bitwise_count(fps[v] ^ point).astype(np.int64)
            todo.append((h[d <= mu], v[dv - radius <= mu]))
            todo.append((h[d > mu], np.concatenate((h[(d <= mu) & (d + radius > mu)], v[dv + radius > mu]))))
            continue
        every = np.concatenate((h, v))
        step = max(1, BLOCK // len(h))
        for i in range(0, len(every), step):
            part = every[i : i + step]
            x, y = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[h][None, :]) <= radius)
            x, y = part[x], h[y]
            a.append(x[x != y])
            b.append(y[x != y])
            kept += len(a[-1])
            if kept > BLOCK:
                a, b = squeeze()
                kept = len(a[0])
    if a:
        a, b = squeeze()
        return fps[a[0]], fps[b[0]]
    return fps[:0], fps[:0]


def dealt_again(dealt: DataFrame, depth: int, radius: int) -> DataFrame:
    """dealt (shard, fp, home) with every shard cut by a tree of its own.

    A shard's rows come sorted, home rows first and in order of a hash: the first
    few are the sample that its tree is built on, the others stream through.
    """
    wanted = SAMPLE * 2**depth

    def cut(batches):
        shard, tree, held = None, None, []

        def routed(fps, home, tree):
            for number, at, is_home in _routed(fps, home, tree, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard * 2 ** (depth + 1) + number, np.int64)), pa.array(at.view(np.int64)), pa.array(np.full(len(at), is_home))], ["shard", "fp", "home"])

        def planted():
            fps, home = (np.concatenate(x) for x in zip(*held))
            return fps, home, build_tree(fps[home][:wanted], depth)

        for b in batches:
            shards, fps, home = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64), np.asarray(b.column(2))
            bounds = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))).tolist() if len(shards) else []
            for lo, hi in zip(bounds, [*bounds[1:], len(shards)]):
                if shards[lo] != shard:
                    if held:
                        yield from routed(*planted())
                    shard, tree, held = int(shards[lo]), None, []
                if tree is None:
                    held.append((fps[lo:hi], home[lo:hi]))
                    if sum(int(h.sum()) for _, h in held) >= wanted or not home[lo:hi].all():
                        *first, tree = planted()
                        held = []
                        yield from routed(*first, tree)
                else:
                    yield from routed(fps[lo:hi], home[lo:hi], tree)
        if held:
            yield from routed(*planted())

    rows = dealt.repartition(shuffle_parts(dealt.sparkSession), "shard").sortWithinPartitions("shard", F.desc("home"), F.xxhash64("fp"))
    return rows.mapInArrow(cut, "shard long, fp long, home boolean")


def _routed(fps: np.ndarray, home: np.ndarray, tree, radius: int):
    """(shard, fingerprints, is home) for home points and for visitors that keep visiting."""
    for number, at, is_home in route(fps[home], tree, radius):
        if len(at):
            yield number, fps[home][at], is_home
    for number, at, _ in route(fps[~home], tree, radius, visitors=True):
        if len(at):
            yield number, fps[~home][at], False


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp) -> (u, v): links that connect exactly the fingerprints that chains of radius connect."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    first = min(depth, LEVEL)
    rows = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE * 2**first).collect() if first else []
    tree = build_tree(np.array([r[0] for r in rows], np.int64).view(np.uint64), first)

    def deal(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64)
            for shard, at, home in route(fps.view(np.uint64), tree, radius):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array(fps[at]), pa.array(np.full(len(at), home))], ["shard", "fp", "home"])

    def within(table: pa.Table) -> pa.Table:
        fps, home = np.asarray(table.column("fp")).astype(np.int64).view(np.uint64), np.asarray(table.column("home"))
        u, v = search(fps[home], fps[~home], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    while first < depth:
        step = min(LEVEL, depth - first)
        dealt = stored(dealt_again(dealt, step, radius), "shards")
        first += step
    return dealt.groupBy("shard").applyInArrow(within, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, percent: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest id in the row's group.

    Rows link if their fingerprints differ in radius bits or fewer; groups are
    the connected components. Null, empty and blank texts have fingerprint 0 and
    link like any other. A null id takes part in links, and counts as a smallest
    id only if its whole group has none. An empty table gives an empty result.
    Columns other than id and text are ignored. Texts of any length are read whole.

    With percent, rows link if the Jaccard likeness of their shingle sets is
    percent / 100 or more, as near_groups() says, which gives the result.
    """
    if percent is not None:
        from .near import near_groups

        return near_groups(docs, id_col, text_col, shingle, percent)
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    members = stored(connected_components(links(distinct, radius)), "members")
    linked = members.join(distinct, members["node"] == distinct["fp"]).select("node", "root", "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = linked.join(roots, "root").select(F.col("node").alias("fp"), "component_id")
    classes = distinct.join(by_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # dealt anew, so that the join has exchanges of its own and adaptive execution can split a hot fingerprint
    return fps.join(classes.hint("rebalance"), "fp").select("doc_id", "fp", "component_id")
