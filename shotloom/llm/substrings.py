"""Substring dedup by compaction of the de Bruijn graph of word windows.

An edge of the graph is a window of WINDOW words; its nodes are its first and its
last WINDOW - 1 words. Consecutive windows of a document that share their
minimizer (the smallest hash of ANCHOR words in them) are read as one path with
its two end nodes; equal windows have equal minimizers, so a minimizer that
occurs once prunes its path, and a join on the minimizer finds the others.

* A minimizer with one path only doesn't branch. Such paths are compacted by
  joins on their nodes: where a node has one path in and one out, and all
  occurrences of the one go on in the other, the two become one longer path.
* A minimizer with several paths branches: the first occurrence of each is
  expanded to its edges once, and edges are compared by their two nodes.
* Occurrences of a compacted path after its first are copies. Adjacent copies on
  one diagonal merge to long spans, each with the coordinates (row, word) of its
  source. Prefix hashes of the words at both coordinates, independent of the
  hashes above, must agree before anything is removed.

Texts are written once, dealt by row; every later pass over them is joined there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import bucketed
from .common import discard, mix64, shuffle_parts, stored, tune
from .spans import PRIMES, powers

WINDOW, ANCHOR = 20, 6
#: Bytes of text hashed at once (a longer text alone).
CHUNK = 1 << 18
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_RNG = np.random.default_rng(20)
#: For each of two independent hashes: a value for each byte, and an odd base for bytes; an odd base for words.
_BYTES = _RNG.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BYTE_BASE, _WORD_BASE = (_RNG.integers(0, 1 << 64, 2, dtype=np.uint64) | np.uint64(1) for _ in range(2))


class _Powers:
    """Powers of a base modulo 2**64, kept and doubled as needed."""

    def __init__(self, base: int):
        self.base, self.table = base % (1 << 64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            self.table = np.concatenate((self.table, self.table * np.uint64(pow(self.base, len(self.table), 1 << 64))))
        return self.table[:n]


_OF_BYTES = [_Powers(int(b)) for b in _BYTE_BASE]
_OF_WORDS = _Powers(int(_WORD_BASE[0]))
_BACK = _Powers(pow(int(_WORD_BASE[0]), -1, 1 << 64))


class Words:
    """The words of a few texts, hashed: doc gives each word's text, first each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = _SPACE[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[:-1]
        edge[offsets] = True
        word = ~space
        starts = np.flatnonzero(word & edge[:-1])
        last = np.ones(len(data), bool)
        last[:-1] = space[1:]
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        ends = np.flatnonzero(word & last) + 1
        self.first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._size, self._letters = ends - starts, data[word]
        self._kept: dict[int, np.ndarray] = {}
        self._sums = None

    def hash(self, k: int) -> np.ndarray:
        """Hash k of each word."""
        size = self._size
        if not len(size):
            return np.zeros(0, np.uint64)
        if k not in self._kept:
            at = np.cumsum(size) - size
            inner = np.arange(size.sum()) - np.repeat(at, size)
            self._kept[k] = mix64(np.add.reduceat(_BYTES[k][self._letters] * _OF_BYTES[k](int(size.max()))[inner], at))
        return self._kept[k]

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hash 0 of `length` words from each start."""
        if self._sums is None:
            h = self.hash(0)
            self._sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * _OF_WORDS(len(h)), out=self._sums[1:])
        return mix64((self._sums[starts + length] - self._sums[starts]) * _BACK(len(self._sums))[starts])

    def prefixes(self, i: int, positions: np.ndarray) -> np.ndarray:
        """Of text i, the sums of hash 1 of its first words, as many as each position says, modulo two primes: one long each."""
        lo, hi = self.first[i], self.first[i + 1]
        own = self.hash(1)[lo:hi]
        out = np.zeros(len(positions), np.int64)
        for k, p in enumerate(PRIMES):
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(own % np.uint64(p) * powers(k, hi - lo) % np.uint64(p), out=sums[1:])
            out |= (sums[positions] % np.uint64(p)).astype(np.int64) << (31 * k)
        return out


def agree(start: int, own: tuple[int, int], source: int, other: tuple[int, int]) -> bool:
    """Whether two spans, given by their starts and the prefix sums at their ends, hold the same words (as many)."""
    for k, p in enumerate(PRIMES):
        a, b = (((x[1] >> 31 * k & 0x7FFFFFFF) - (x[0] >> 31 * k & 0x7FFFFFFF)) % p for x in (own, other))
        least = min(start, source)
        shift = powers(k, max(start, source) - least + 1)
        if (a * int(shift[source - least]) - b * int(shift[start - least])) % p:
            return False
    return True


def paths(words: Words, window: int, anchor: int, ends: bool = True):
    """(text, start in the text, windows, minimizer, first node, last node) of every run of windows with one minimizer."""
    n = len(words.doc) - window + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if n <= 0:
        return none
    whole = words.doc[:n] == words.doc[window - 1 :]
    grams = len(words.doc) - anchor + 1
    own = words.hash(0)
    h = np.zeros(grams, np.uint64)
    for i in range(anchor):
        h = h * np.uint64(0x9E3779B97F4A7C15) + own[i : i + grams]
    h = mix64(h)
    # leftmost smallest hash of `window - anchor + 1` grams, by doubling
    at, width, wanted = np.arange(grams), 1, window - anchor + 1
    while width < wanted:
        step = min(width, wanted - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        width += step
    at = at[:n]
    p = np.flatnonzero(whole)
    if not len(p):
        return none
    new = np.ones(len(p), bool)
    new[1:] = (at[p[1:]] != at[p[:-1]]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(p)))
    start = p[begin]
    text = words.doc[start]
    nodes = (words.spans(start, window - 1), words.spans(start + count, window - 1)) if ends else none[-2:]
    return text, start - words.first[text], count, h[at[start]], *nodes


def _chunks(column: pa.Array):
    """Runs of texts of a string column as (first row, last row, bytes, offsets); null texts are empty."""
    wide = pa.types.is_large_string(column.type)
    column = pa.array(column.to_pylist(), column.type) if column.offset else column
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[: len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _place() -> Column:
    """Source coordinates of a row, in the order in which they count as earlier."""
    return F.struct(F.col("id").isNull().alias("nil"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("start").alias("start"))


def _first() -> Column:
    return F.min(F.struct(_place().alias("place"), F.col("r").alias("r"))).alias("first")


def repeated_paths(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, l, g, r, id, start, n): the paths whose minimizer occurs more than once; l and g are the end nodes."""

    def minimizers(batches):
        for b in batches:
            for _, _, data, offsets in _chunks(b.column(0)):
                a, c = np.unique(paths(Words(data, offsets), window, anchor, ends=False)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.astype(np.int32))], ["a", "c"])

    def read(batches):
        for b in batches:
            for lo, hi, data, offsets in _chunks(b.column(2)):
                text, start, count, a, l, g = paths(Words(data, offsets), window, anchor)
                of = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (a, l, g)), b.column(0).take(of), b.column(1).take(of), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["a", "l", "g", "r", "id", "start", "n"]
                )

    again = texts.select("text").mapInArrow(minimizers, "a long, c int").groupBy("a").agg(F.sum("c").alias("c")).where("c > 1").select("a")
    again = stored(again, "anchors", free=True)
    every = texts.select("r", "id", "text").mapInArrow(read, "a long, l long, g long, r long, id long, start int, n int")
    some = stored(every.join(again, "a"), "repeated", free=True)
    discard(again)
    return some


def compacted(known: DataFrame) -> DataFrame:
    """Variants that repeat -> (a, l, g, n, first, length): one row for each compacted path, by its first piece; length in windows.

    Pieces that don't branch are joined on their nodes. A piece continues another
    if the node between them has one way in and one out, they lie side by side at
    their first coordinates, and their occurrences are the same but for the shift:
    as many, and with the same sums of row hashes and of row hashes times starts.
    """
    keys = ["a", "l", "g", "n"]
    pieces = known.where("not branch").select(*keys, "c", "h", "z", F.col("first.r").alias("r"), F.col("first.place.start").alias("start"))
    before = F.struct("c", "h", (F.col("z") + F.col("n") * F.col("h")).alias("z"), "r", (F.col("start") + F.col("n")).alias("start"))
    none = F.lit(None).cast(pieces.select(before.alias("x")).schema["x"].dataType)
    ways = pieces.select(F.col("l").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into"), none.alias("x"))
    ways = ways.unionByName(pieces.select(F.col("g").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into"), before.alias("x")))
    nodes = ways.groupBy("v").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.max("x").alias("x")).where("out = 1 and into = 1").select("v", "x")
    same = [F.col(f"x.{c}") == F.col(c) for c in ("c", "h", "z", "r", "start")]
    goes_on = F.coalesce(same[0] & same[1] & same[2] & same[3] & same[4], F.lit(False))
    joined = pieces.join(nodes, pieces["l"] == nodes["v"], "left").select(*keys, "r", "start", goes_on.alias("goes_on"))
    line = Window.partitionBy("r").orderBy("start")  # the pieces of one row, at most as many as its words
    numbered = joined.withColumn("path", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(line))
    whole = numbered.groupBy("r", "path").agg(F.sum("n").cast("int").alias("length"), F.min(F.struct("start", *keys)).alias("head"))
    whole = whole.select("r", "head.*", "length")
    # where several pieces branch, each repeated variant stays by itself
    return whole.select(*keys, "r", "start", "length").unionByName(known.where("branch and c > 1").select(*keys, F.col("first.r").alias("r"), F.col("first.place.start").alias("start"), F.col("n").alias("length")))


def copies(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(r, start, n, sr, ss): spans of n windows from word `start` of row r that also start at word ss of row sr, which counts as earlier."""
    some = repeated_paths(texts, window, anchor)
    keys = ["a", "l", "g", "n"]
    shade = F.hash("r").cast("long") + (1 << 31)
    z = F.sum((shade * F.col("start")).cast("decimal(20,0)")).cast("decimal(38,0)")
    variants = some.groupBy(*keys).agg(F.count("*").alias("c"), F.sum(shade).cast("decimal(38,0)").alias("h"), z.alias("z"), _first())
    branching = variants.groupBy("a").agg((F.count("*") > 1).alias("branch"))
    known = stored(variants.join(branching.hint("rebalance"), "a"), "known", free=True)

    heads = compacted(known).withColumnsRenamed({"r": "sr", "start": "ss"})
    ids = known.select(*keys, F.col("first.place").alias("place"))
    heads = stored(heads.join(ids, keys), "heads", free=True)
    later = some.join(heads, keys).where(_place() > F.col("place")).select("r", "start", F.col("length").alias("n"), "sr", "ss")
    later = stored(later, "later", free=True)
    discard(some)

    def expand(batches):
        for b in batches:
            wants = b.column(3)
            for lo, hi, data, offsets in _chunks(b.column(2)):
                words = Words(data, offsets)
                own = wants.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), np.asarray(own.value_lengths()))
                start, n = (np.asarray(own.flatten().field(k)).astype(np.int64) for k in ("start", "n"))
                if not len(row):
                    continue
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, start = np.repeat(row, n), np.repeat(start, n) + each
                at = words.first[row] + start
                nodes = [words.spans(at + k, window - 1).view(np.int64) for k in (0, 1)]
                of = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([*map(pa.array, nodes), b.column(0).take(of), b.column(1).take(of), pa.array(start.astype(np.int32))], ["l", "g", "r", "id", "start"])

    # the first occurrences of branching variants, by row: at most as many as the row has words
    wants = known.where("branch").groupBy(F.col("first.r").alias("r")).agg(F.collect_list(F.struct(F.col("first.place.start").alias("start"), "n")).alias("wants"))
    edges = texts.select("r", "id", "text").join(wants.hint("shuffle_hash"), "r").select("r", "id", "text", "wants")
    edges = stored(edges.mapInArrow(expand, "l long, g long, r long, id long, start int"), "edges", free=True)
    first = stored(edges.groupBy("l", "g").agg(F.count("*").alias("_times"), _first()).where("_times > 1").select("l", "g", "first"), "first", free=True)
    single = edges.join(first, ["l", "g"]).where(_place() > F.col("first.place"))
    single = single.select("r", "start", F.lit(1).alias("n"), F.col("first.r").alias("sr"), F.col("first.place.start").alias("ss"))

    def merge(batches):
        for b in batches:
            lists, rows = b.column(1), np.asarray(b.column(0))
            row = np.repeat(rows, np.asarray(lists.value_lengths()))
            start, n, sr, ss = (np.asarray(lists.flatten().field(k)).astype(np.int64) for k in ("start", "n", "sr", "ss"))
            order = np.lexsort((start, row))
            row, start, n, sr, ss = (x[order] for x in (row, start, n, sr, ss))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (sr[1:] != sr[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (ss[1:] != ss[:-1] + n[:-1])
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at) if len(at) else n
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(start[at].astype(np.int32)), pa.array(total.astype(np.int32)), pa.array(sr[at]), pa.array(ss[at].astype(np.int32))], ["r", "start", "n", "sr", "ss"])

    hits = later.unionByName(single).groupBy("r").agg(F.collect_list(F.struct("start", "n", "sr", "ss")).alias("hits"))
    spans = stored(hits.mapInArrow(merge, "r long, start int, n int, sr long, ss int"), "spans", free=True)
    for x in (known, heads, later, edges, first):
        discard(x)
    return spans


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, carry: list[str] = (), layout: bool = False) -> DataFrame:
    """(carried columns, doc_id, n_words, n_removed, kept) for each row of docs.

    Words are runs without ASCII white space, unchanged. A word is removed if a
    window of `window` consecutive words that covers it also starts earlier: in a
    row with a smaller id, or earlier in the same row. kept is the other words,
    joined by one space; with layout, a text that loses no word stays as it is.
    Windows are judged on the input.

    Null and empty texts have no words; texts shorter than a window keep all.
    Null ids come last; rows that share an id count as one document, so equal
    rows don't remove each other. Texts are read whole, and an empty table gives
    an empty result. Columns that aren't carried are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    names = [f"_c{i}" for i in range(len(carry))]
    texts = docs.select(
        F.monotonically_increasing_id().alias("r"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.col(id_col).alias("_id"), *(F.col(c).alias(a) for c, a in zip(carry, names)),
    )
    texts = bucketed(texts, "texts", "r", shuffle_parts(spark))
    spans = copies(texts, window, anchor)

    def sums(batches):
        for b in batches:
            wanted = b.column(2)
            for lo, hi, data, offsets in _chunks(b.column(1)):
                words = Words(data, offsets)
                own = [np.asarray(wanted[i].values).astype(np.int64) for i in range(lo, hi)]
                h = [words.prefixes(i, p) for i, p in enumerate(own)]
                row = np.repeat(np.asarray(b.column(0).slice(lo, hi - lo)), list(map(len, own)))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate(own).astype(np.int32)), pa.array(np.concatenate(h))], ["sr", "at", "sum"])

    # prefix sums at the source coordinates; of one row at most as many as it has words
    end = (F.col("ss") + F.col("n") + (window - 1)).alias("se")
    ends = spans.select("sr", F.col("ss").alias("at")).unionByName(spans.select("sr", end.alias("at"))).distinct()
    ends = ends.groupBy(F.col("sr").alias("r")).agg(F.collect_list("at").alias("ends"))
    marks = texts.select("r", "text").join(ends.hint("shuffle_hash"), "r").select("r", "text", "ends").mapInArrow(sums, "sr long, at int, sum long")
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ss").alias("at")), F.struct(F.lit(1).alias("side"), end.alias("at")))).alias("x")
    found = spans.select("r", "start", "n", "sr", "ss", both).select("r", "start", "n", "sr", "ss", "x.side", "x.at").join(marks, ["sr", "at"])
    found = found.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("start", "side", "n", "ss", "sum"))).alias("spans"))
    rows = texts.join(found.hint("shuffle_hash"), "r", "left").select("_id", *names, "text", "spans")

    def gone_in(column: pa.Array, lists: pa.Array) -> dict[int, np.ndarray]:
        """Row -> which of its words go, for the rows with spans."""
        some = pa.array(np.flatnonzero(np.asarray(lists.is_valid())))
        out, lists = {}, lists.take(some)
        for lo, hi, data, offsets in _chunks(column.take(some)):
            words = Words(data, offsets)
            for i in range(lo, hi):
                start, n, ss, sums_ = (np.asarray(lists[i].values.field(k)).astype(np.int64) for k in ("start", "n", "ss", "sum"))
                start, n, ss, low, high = start[::2], n[::2], ss[::2], sums_[::2], sums_[1::2]  # a span's two ends follow each other
                ends = np.stack((start, start + n + window - 1), 1)
                own = words.prefixes(i - lo, ends.ravel()).reshape(-1, 2)
                change = np.zeros(words.first[i - lo + 1] - words.first[i - lo] + 1, np.int64)
                for (a, z), mine, source, x, y in zip(ends.tolist(), own.tolist(), ss.tolist(), low.tolist(), high.tolist()):
                    if agree(a, mine, source, (x, y)):
                        change[a] += 1
                        change[z] -= 1
                out[some[i].as_py()] = np.cumsum(change[:-1]) > 0
        return out

    def remove(batches):
        at = len(names) + 1
        for b in batches:
            total, gone, kept = [], [], []
            away = gone_in(b.column(at), b.column(at + 1))
            for i, text in enumerate(b.column(at).to_pylist()):
                words = text.encode().split() if text else []
                drop = away[i].tolist() if i in away else ()
                total.append(len(words))
                gone.append(sum(drop))
                if gone[-1]:
                    words = [w for w, x in zip(words, drop) if not x]
                kept.append(text or "" if layout and not gone[-1] else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["_id", *names, "n_words", "n_removed", "kept"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("_id", *names)]
    out = rows.mapInArrow(remove, ", ".join([*kinds, "n_words long, n_removed long, kept string"]))
    return out.select(*[F.col(a).alias(c) for c, a in zip(carry, names)], F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept")
