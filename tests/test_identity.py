"""Local and global identities, against plain versions on random tracks and vectors."""

import numpy as np
from pyspark.sql import functions as F

from shotloom.functions.vectors import mean_vectors
from shotloom.operators import identity

TRACKS = "shot_id long, track_ord long, first_frame int, last_frame int, mean array<double>, local_id int"


def plain_local(rows, threshold, start):
    """rows (first, last, vector or None, id or None) in order -> ids."""
    unit = [None if r[2] is None else np.array(r[2]) / np.linalg.norm(r[2]) for r in rows]
    ids = [r[3] for r in rows]
    apart = lambda i, j: rows[i][1] < rows[j][0] or rows[j][1] < rows[i][0]
    like = lambda i, j: unit[i] is not None and unit[j] is not None and apart(i, j) and float(unit[i] @ unit[j]) >= threshold
    named = [i for i, x in enumerate(ids) if x is not None]
    left = []
    for i in range(len(rows)):
        if ids[i] is None:
            fits = [j for j in named if like(i, j)]
            if fits:
                ids[i] = ids[max(fits, key=lambda j: float(unit[i] @ unit[j]))]
                named.append(i)
            else:
                left.append(i)
    for i in left:
        if ids[i] is None:
            ids[i] = start
            for j in left:
                if ids[j] is None and like(i, j):
                    ids[j] = start
            start += 1
    return ids


def test_local_ids(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for shot in range(60):
        n = int(rng.integers(0, 9))
        faces = rng.normal(size=(3, 6))
        own = []
        for _ in range(n):
            a = int(rng.integers(0, 30))
            v = None if rng.random() < 0.15 else (faces[rng.integers(0, 3)] + rng.normal(size=6) * 0.4).tolist()
            own.append((a, a + int(rng.integers(0, 8)), v, int(rng.integers(70, 73)) if rng.random() < 0.25 else None))
        rows += [(shot, i, *r) for i, r in enumerate(own)]
        want |= {(shot, i): x for i, x in enumerate(plain_local(own, 0.75, 200))}
    got = identity.local_ids(spark.createDataFrame(rows, TRACKS), 0.75, 200).collect()
    assert {(r["shot_id"], r["track_ord"]): r["local_id"] for r in got} == want and len(set(want.values())) > 5


def test_members_may_overlap_each_other(spark):
    """Frames are compared with the leader's only."""
    v = [3.0, 4.0]
    rows = [(7, 0, 0, 2, v, None), (7, 1, 6, 12, v, None), (7, 2, 8, 9, v, None), (7, 3, 2, 3, v, None)]
    got = identity.local_ids(spark.createDataFrame(rows, TRACKS), 0.9).orderBy("track_ord").collect()
    assert [r["local_id"] for r in got] == [0, 0, 0, 1]


def clustered(rng, n, width, spread):
    centres = rng.normal(size=(12, width))
    return [(centres[rng.integers(0, 12)] + rng.normal(size=width) * spread).tolist() for _ in range(n)]


def test_similar_pairs_and_global_ids(spark, monkeypatch):
    """Many blocks and pivots lose no pair; null and zero vectors come last, in order of id."""
    rng = np.random.default_rng(5)
    vectors = clustered(rng, 300, 10, 0.15) + [None, [0.0] * 10]
    rng.shuffle(vectors)
    m = np.array([v or [0.0] * 10 for v in vectors])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(length == 0, 1, length)
    s = m @ m.T
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    for block, pivots in ((2048, 256), (25, 256), (40, 3)):
        monkeypatch.setattr(identity, "BLOCK", block)
        monkeypatch.setattr(identity, "PIVOTS", pivots)
        got = identity.similar_pairs(df, 0.9).collect()
        want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] >= 0.9}
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
        assert all(abs(r["similarity"] - s[r["a"], r["b"]]) < 1e-12 for r in got)
        label = list(range(len(m)))
        for i, j in want:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
        usable = sorted({label[i] for i in range(len(m)) if length[i] > 0})
        number = {x: 30 + k for k, x in enumerate(usable)} | {i: 30 + len(usable) + k for k, i in enumerate(i for i in range(len(m)) if length[i] == 0)}
        ids = {r["id"]: r["global_id"] for r in identity.global_ids(df, 0.9, start=30).collect()}
        assert ids == {i: number[label[i]] for i in range(len(m))}


def test_cells_out_of_reach_are_not_compared(spark, monkeypatch):
    """On clustered vectors few copies of a vector are sent out, against one for each block."""
    monkeypatch.setattr(identity, "BLOCK", 20)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(list(enumerate(clustered(rng, 1200, 24, 0.02))), "id long, v array<double>")
    sent = {}
    monkeypatch.setattr(identity, "_unit_rows", identity._unit_rows)
    found = identity.similar_pairs(df, 0.95)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    near = [len(x) for x in _near(df, 0.95)]
    sent["blocks"] = sum(near) / len(near)
    assert sent["blocks"] < 60 / 4


def _near(df, threshold):
    """The cells in reach of each cell, as similar_pairs() finds them."""
    seen = []
    keep = identity.F.create_map
    identity.F.create_map = lambda *a: seen.append(a) or keep(*a)
    try:
        identity.similar_pairs(df, threshold)
    finally:
        identity.F.create_map = keep
    return [str(x).split("struct(")[1:] for x in seen[0][1::2]]


def test_single_precision(spark):
    a = [0.6, 0.8]
    df = spark.createDataFrame([(0, a), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    assert {(r["a"], r["b"]) for r in identity.similar_pairs(df, 0.6, single=True).collect()} == {(0, 1), (0, 2)}


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, None), (2, None)], "k int, v array<float>")
    assert {r["k"]: r["mean"] for r in mean_vectors(df, ["k"], "v").collect()} == {1: [0.5, 0.5], 2: None}
    assert df.where(F.col("k") == 3).count() == 0


def test_components_by_blocks(spark, monkeypatch):
    """Blocks of few vectors, known links, a large component and none: the components of all pairs."""
    rng = np.random.default_rng(21)
    monkeypatch.setattr(identity, "BLOCK", 30)
    monkeypatch.setattr(identity, "QUERIES", 8 * 8 * 25)
    chain = np.linspace(0, 1.5, 140)  # neighbours are alike, the ends aren't
    vectors = [np.r_[np.cos(x), np.sin(x), np.zeros(6)] for x in chain] + list(np.eye(8)[2:]) + [np.array(v) for v in clustered(rng, 60, 8, 0.1)] + [np.zeros(8)]
    order = rng.permutation(len(vectors))
    m = np.array(vectors)[order]
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    alike = unit @ unit.T >= 0.99
    label = list(range(len(m)))
    for i, j in zip(*np.nonzero(alike)):
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    known = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(alike, 1)))]
    for links in (None, known[::2], [(i, j) for i, j in known if label[i] != label[int(np.flatnonzero(order == 0)[0])]]):
        given = links and spark.createDataFrame(links, "u long, v long")
        got = {r["node"]: r["root"] for r in identity.components(df, 0.99, links=given).collect()}
        assert got == dict(enumerate(label)) and max(label.count(x) for x in label) >= 140
