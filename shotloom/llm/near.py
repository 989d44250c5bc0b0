"""Near duplicates for corpora: operator 10's links, carried on to a Jaccard likeness of word-shingle sets.

Fingerprints within RADIUS bits, found by the vantage-point trees of simhash.py,
join most near copies. At a likeness of 0.8 fingerprints lie up to 11 bits
apart, and in 64 bits a ball of that radius prunes no branch: distances of
unlike texts crowd at 32, so that the search would compare nearly all with all.
What lies further apart is therefore proposed by bands of minima of the same
shingles. Every pair, of either kind, is verified on the whole sets. A pair at
0.8 is proposed but for a chance of (1 - 0.8 ** 5) ** 40, about one in eight
million, and passes the comparison of minima but for one in 10,000; likelier
pairs are missed less often still.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import mix64, shuffle_parts, stored, tune
from .simhash import LOWER, SEED, links, majority

#: Bands of minima and minima in each; shingles hashed at a time.
BANDS, ROWS, STEP = 40, 5, 512
#: Minima in a word, four bits of each, and how many of a pair's 200 must be equal: at likeness 0.8 162 are, with a deviation of 5.5.
NIBBLES, EQUAL = 15, 142
WORDS = -(-BANDS * ROWS // NIBBLES)
#: Rows of a key that are compared at once with as many others.
BLOCK = 2048
#: Bits within which fingerprints are linked by vantage-point trees.
RADIUS = 2
#: Rounds at most in which texts only meet leaders of the keys they have, and how many of these: those that they share most keys with.
TURNS, LEADS = 4, 1
LOW3, HIGH1 = (sum(x << 4 * i for i in range(NIBBLES)) for x in (7, 8))
PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, sorted.

    Words are as in simhash.fingerprint(). A text with fewer words than a
    shingle is one shingle, one without words too.
    """
    words = text.encode().translate(LOWER).split() if text else []
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    k = min(shingle, len(own))
    out = np.full(max(1, len(own) - k + 1) if k else 1, k, np.uint64)
    for i in range(k):
        out *= PRIME
        out ^= own[i : len(own) - k + 1 + i]
        mix64(out)
    return np.unique(out)


def keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key for each band, and four bits of each minimum in words of NIBBLES.

    Sets of likeness j share a band's key with chance j ** ROWS, and a minimum's four bits with j + (1 - j) / 16.
    """
    low = found.astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), STEP):
        np.minimum(least, (low[i : i + STEP, None] * FACTORS + SHIFTS).min(0), out=least)
    padded = np.zeros(WORDS * NIBBLES, np.uint64)
    padded[: len(least)] = mix64(least.astype(np.uint64)) & np.uint64(15)
    # the four highest bits stay zero, so that sums of two words stay within a long
    words = (padded.reshape(WORDS, NIBBLES) << np.arange(0, 4 * NIBBLES, 4, dtype=np.uint64)).sum(1, dtype=np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out *= PRIME
        out ^= column.astype(np.uint64)
        mix64(out)
    return out, words


def _lists(arrays: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(kind)))


def near_links(texts: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """texts (node, text), equal texts under one node -> (u, v): links of likeness percent / 100 or more.

    The links connect what all such pairs connect; pairs that others already
    connect may be missing. In large buckets, texts that share a key first meet a
    few leaders; then all that this leaves in different components meet each
    other, so that a large group of copies isn't squared.
    """
    tune(texts.sparkSession)

    def banded(batches):
        for b in batches:
            if b.num_rows:
                sets = [shingles(t, shingle) for t in b.column(1).to_pylist()]
                found, bits = zip(*map(keys, sets))
                fps = pa.array([majority(s) for s in sets], pa.uint64()).view(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), fps, _lists(bits), _lists(found)], ["node", "n", "fp", "bits", "keys"])

    def whole(batches):
        for b in batches:
            if b.num_rows:
                # 32 bits of a shingle's hash suffice to compare two texts, and half as much moves
                own = [np.unique(shingles(t, shingle).astype(np.uint32)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(own, np.int32)], ["node", "grams"])

    banded = texts.select("node", "text").mapInArrow(banded, "node long, n int, fp long, bits array<long>, keys array<long>")
    banded = stored(banded.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bits", "keys")]), "bands")
    rows = banded.select("node", F.posexplode("keys").alias("band", "key"))
    several = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(rows.join(several.hint("rebalance"), "key").select("key", "band", "node", "size"), "shared")
    # how often a node meets others: the midst of a group of copies meets most
    degrees = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    shared = shared.drop("size")

    nodes = shared.select("node").distinct()
    sets = texts.select("node", "text").join(nodes.hint("rebalance"), "node", "left_semi").mapInArrow(whole, "node long, grams array<int>")
    sets = stored(sets.groupBy("node").agg(F.first("grams").alias("grams")), "grams")
    one, other = (sets.select("node", F.col("grams").alias(f"grams_{s}")).hint("rebalance") for s in "uv")

    def judged(pairs: DataFrame) -> DataFrame:
        """(u, v, common, total): how many shingles two texts share, and have together."""
        common = F.size(F.array_intersect("grams_u", "grams_v"))
        rows = pairs.join(one, pairs["u"] == one["node"]).drop("node")
        rows = rows.join(other, rows["v"] == other["node"])
        return rows.select("u", "v", common.alias("common"), (F.size("grams_u") + F.size("grams_v")).alias("both")).select("u", "v", "common", (F.col("both") - F.col("common")).alias("total"))

    def verified(pairs: DataFrame) -> DataFrame:
        return judged(pairs).where(F.col("common") * 100 >= F.col("total") * percent).select("u", "v")

    # equal fingerprints meet their smallest text, others the links of the vantage-point search
    by_fp = stored(banded.groupBy("fp").agg(F.min("node").alias("least")), "fps")
    equal = banded.select("fp", "node").join(by_fp.hint("rebalance"), "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    apart = links(by_fp, RADIUS)
    for side in "uv":
        apart = apart.withColumnRenamed(side, "fp").join(by_fp, "fp").drop("fp").withColumnRenamed("least", side)
    found = stored(verified(equal.unionByName(apart)), "links", free=True)
    before = anchors = None
    for turn in range(TURNS + 1):
        roots = connected_components(found).select("node", F.col("root").alias("of")).hint("rebalance")
        rooted = shared.select("key", "band", "node").join(roots, "node", "left").select("key", "band", "node", F.coalesce("of", "node").alias("root"))
        parts = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        # of each row, how many with its key are in other components, on average
        parts = parts.select("key", (F.col("s") - F.col("q") / F.col("s")).alias("open")).where("open > 0")
        told = Observation()
        shared = rooted.join(parts.hint("rebalance"), "key").observe(told, F.count("*").alias("n"), F.sum("open").alias("open"))
        shared = stored(shared, "mixed")
        left, n = told.get["open"] or 0, told.get["n"]
        if turn == TURNS or left <= 2 * n or before and left > before / 2:
            break
        before = left
        # the first leaders are the midsts of their groups, later ones are drawn
        ranked = shared.join(degrees, "node").withColumn("rank", -F.col("degree")) if not turn else shared.withColumn("rank", F.xxhash64("node", F.lit(turn)))
        leads = ranked.groupBy("key").agg(F.min(F.struct("rank", F.col("node").alias("u"), F.col("root").alias("root_u"))).alias("lead")).hint("rebalance")
        stars = shared.join(leads, "key").select("node", "root", "lead.*").where(F.col("root_u") != F.col("root"))
        # of at most as many leaders as there are bands, those that share most keys
        most = stars.groupBy("node", "u").agg(F.count("*").alias("c")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "u"))).alias("leads"))
        stars = most.select(F.col("node").alias("v"), F.explode(F.slice("leads", 1, LEADS)).alias("lead")).select("lead.u", "lead.c", "v")
        near = stored(judged(stars.select("u", "v")), "judged", free=True)
        if anchors is None:
            # each node's distance from the leader that it shares most keys with: vantage points for the last comparison
            first = most.select(F.col("node").alias("v"), F.col("leads")[0]["u"].alias("u"))
            far = near.join(first, ["u", "v"]).select(F.col("v").alias("node"), F.col("u").alias("anchor"), (1 - F.col("common") / F.col("total")).alias("distance"))
            own = first.select(F.col("u").alias("node"), F.col("u").alias("anchor"), F.lit(0.0).alias("distance")).distinct()
            anchors = stored(far.join(own.select("node"), "node", "left_anti").unionByName(own), "anchors")
        found = stored(found.unionByName(near.where(F.col("common") * 100 >= F.col("total") * percent).select("u", "v")), "links", free=True)
    rest = stored(_open_pairs(shared, banded, anchors, percent), "rest", free=True)
    return found.unionByName(verified(rest))


def _open_pairs(shared: DataFrame, banded: DataFrame, anchors: DataFrame | None, percent: int) -> DataFrame:
    """shared (key, band, node, root) -> (u, v): all pairs that share a key, have different roots and are alike enough by their minima; each once.

    Texts with one anchor whose distances from it differ by more than a link
    allows can't be linked: 1 minus the Jaccard likeness is a metric.

    Rows of a key are cut into blocks of about BLOCK; a task compares two blocks
    at a time and streams through its keys. Of the keys that a pair shares only
    that of the first band reports it.
    """
    sizes = shared.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = shared.join(sizes.hint("rebalance"), "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    rows = rows.select("key", "band", "node", "root", "b", F.explode(pair).alias("p")).select("key", "band", "node", "root", "b", "p.i", "p.j")
    rows = rows.join(banded.select("node", "n", "bits", "keys").hint("rebalance"), "node")
    if anchors is None:
        rows = rows.withColumn("anchor", F.lit(0).cast("long")).withColumn("distance", F.lit(0.0))
    else:
        rows = rows.join(anchors.hint("rebalance"), "node", "left").withColumn("anchor", F.coalesce("anchor", "node")).withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    sent = rows.select("key", "i", "j", "b", "band", "node", "root", "n", "anchor", "distance", "bits", "keys")
    sent = sent.repartition(shuffle_parts(shared.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(columns: list[np.ndarray]):
        """Of the rows of one pair of blocks: positions of the pairs that are open and alike."""
        i, j, b, band, _, root, n, anchor, distance, bits, keys = columns
        left, right = (np.flatnonzero(b == i[0]), np.flatnonzero(b == j[0])) if i[0] != j[0] else (np.arange(len(b)),) * 2
        low, high = np.minimum(n[left][:, None], n[right][None, :]).astype(np.int64), np.maximum(n[left][:, None], n[right][None, :])
        open_ = (root[left][:, None] != root[right][None, :]) & (low * 100 >= high.astype(np.int64) * percent)
        open_ &= (anchor[left][:, None] != anchor[right][None, :]) | (np.abs(distance[left][:, None] - distance[right][None, :]) <= 1 - percent / 100 + 1e-9)
        if i[0] == j[0]:
            open_ = np.triu(open_, 1)
        if len(left) * len(right) > 64:  # else the few pairs are compared one by one below
            differ = np.zeros(open_.shape, np.uint8)
            for w in range(WORDS):
                x = bits[left, w][:, None] ^ bits[right, w][None, :]
                differ += np.bitwise_count(((x & np.uint64(LOW3)) + np.uint64(LOW3) | x) & np.uint64(HIGH1))
            open_ &= differ <= BANDS * ROWS - EQUAL
        x, y = np.nonzero(open_)
        x, y = left[x], right[y]
        z = bits[x] ^ bits[y]
        alike = np.bitwise_count(((z & np.uint64(LOW3)) + np.uint64(LOW3) | z) & np.uint64(HIGH1)).sum(1) <= BANDS * ROWS - EQUAL
        x, y = x[alike], y[alike]
        return x, y, ((keys[x] == keys[y]) & (np.arange(BANDS) < band[x][:, None])).any(1)

    def compare(batches):
        held: list[list[np.ndarray]] = []
        at = None

        def done():
            columns = [np.concatenate(c) for c in zip(*held)]
            x, y, before = pairs(columns)
            node = columns[4]
            u, v = node[x[~before]], node[y[~before]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            key, i, j = (np.asarray(b.column(k)) for k in range(3))
            flat = [np.asarray(b.column(k)) for k in range(1, 10)]
            flat += [np.asarray(b.column(k).flatten()).view(np.uint64).reshape(-1, width) for k, width in ((10, WORDS), (11, BANDS))]
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(key)]):
                mark = (key[lo], i[lo], j[lo])
                if held and mark != at:
                    yield done()
                    held = []
                at = mark
                held.append([c[lo:hi] for c in flat])
        if held:
            yield done()

    return sent.mapInArrow(compare, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, node, component_id, first) for each row of docs; component_id is the smallest id in the row's group.

    Rows link if their texts are equal or the Jaccard likeness of their shingle
    sets is percent / 100 or more; groups are the connected components. node is a
    hash of the text, and first the node of the group's row with the smallest id
    (then the smallest node). Texts without words are alike. A null id takes part
    in links, and counts as a smallest id only if its whole group has none. An
    empty table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    members = stored(connected_components(near_links(rows, shingle, percent)), "members")
    ids = rows.select("doc_id", "node")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), F.col("doc_id").alias("id"), "node")).alias("least")
    least = stored(ids.groupBy("node").agg(own), "least")
    linked = least.join(members, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    roots = linked.groupBy("root").agg(F.min("least").alias("least"))
    classes = linked.drop("least").join(roots.hint("rebalance"), "root").select("node", F.col("least.id").alias("component_id"), F.col("least.node").alias("first"))
    # dealt anew, as in simhash_groups()
    return ids.join(classes.hint("rebalance"), "node").select("doc_id", "node", "component_id", "first")
