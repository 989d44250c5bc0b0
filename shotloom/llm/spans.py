"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for two primes, sum(c[j] * B**j) modulo the prime
over its first i code points. Any span's hash follows from two entries, so spans
are compared in constant time and the longest common extension of two positions
is found by binary search.

The fingerprint carries the text's length, its whole hash and a sample of span
hashes: the text is cut where the hash of the CUT code points that follow is a
multiple of EVERY, and of the distinct spans between cuts the KEPT smallest
hashes stay. Texts that share passages share spans wherever these lie, so the
likeness of two texts is read from their fingerprints alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix64, shuffle_parts, tune

#: Two primes below 2**31 and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
_POWERS = [np.ones(1, np.uint64) for _ in PRIMES]
_BACK = [np.ones(1, np.uint64) for _ in PRIMES]
#: Code points that decide on a cut, mean length of a span, span hashes in a fingerprint; rows aimed at in a range of ids.
CUT, EVERY, KEPT = 16, 32, 24
RANGE = 20_000


def powers(k: int, n: int, table: list = _POWERS, bases: tuple[int, int] = BASES) -> np.ndarray:
    """bases[k]**i modulo PRIMES[k] for i < n; kept and doubled as needed."""
    p = np.uint64(PRIMES[k])
    while len(table[k]) < n:
        have = table[k]
        table[k] = np.concatenate((have, have * np.uint64(pow(bases[k], len(have), PRIMES[k])) % p))
    return table[k][:n]


def inverses(k: int, n: int) -> np.ndarray:
    """BASES[k]**-i modulo PRIMES[k] for i < n."""
    return powers(k, n, _BACK, tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES)))


def points(text: str | None) -> np.ndarray:
    """The text's code points; null is empty."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, code_points: np.ndarray):
        self.n = len(code_points)
        c = code_points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * powers(k, self.n) % np.uint64(p), out=s[1:])
            s %= np.uint64(p)
            self.sums.append(s)

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether length code points from i equal those of other from j."""
        for k, p in enumerate(PRIMES):
            a = int(self.sums[k][i + length]) - int(self.sums[k][i])
            b = int(other.sums[k][j + length]) - int(other.sums[k][j])
            if i < j:
                a *= int(powers(k, j - i + 1)[j - i])
            elif j < i:
                b *= int(powers(k, i - j + 1)[i - j])
            if (a - b) % p:
                return False
        return True

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension from positions i and j."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(i, other, j, mid) else (lo, mid - 1)
        return lo

    def extension_back(self, other: Prefixes) -> int:
        """Length of the longest common end."""
        lo, hi = 0, min(self.n, other.n)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(self.n - mid, other, other.n - mid, mid) else (lo, mid - 1)
        return lo

    def spans(self, k: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash k of the spans from start to stop, wherever they lie."""
        p = np.uint64(PRIMES[k])
        s = self.sums[k]
        return (s[stop] + p - s[start]) % p * inverses(k, self.n + 1)[start] % p

    def fingerprint(self) -> str:
        """Length, whole hash and the smallest span hashes, in hex: equal for equal texts."""
        starts = np.arange(max(0, self.n - CUT + 1))
        cuts = np.flatnonzero(self.spans(0, starts, starts + CUT) % np.uint64(EVERY) == 0)
        bounds = np.unique(np.concatenate(([0], cuts, [self.n])))
        found = mix64(self.spans(0, bounds[:-1], bounds[1:]) << np.uint64(31) | self.spans(1, bounds[:-1], bounds[1:]))
        kept = np.unique(found >> np.uint64(32))[:KEPT]
        whole = f"{self.n:x}-{int(self.sums[0][-1]):08x}{int(self.sums[1][-1]):08x}"
        return "-".join([whole, "".join(f"{x:08x}" for x in kept.tolist())])

    def likeness(self, other: Prefixes) -> float:
        """Common start and end, not overlapping, over the longer length; 1 for two empty texts."""
        most = max(self.n, other.n)
        if not most:
            return 1.0
        start = self.extension(0, other, 0)
        return min(start + self.extension_back(other), self.n, other.n) / most


def likeness(one: str, other: str) -> float:
    """How much two texts have in common, by their fingerprints: twice the shared spans over the spans of both; 1 for equal ones.

    The share j of the KEPT smallest hashes of both together that each has
    estimates the spans' Jaccard likeness; this is 2 * j / (1 + j).
    """
    if one == other:
        return 1.0
    a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (f.split("-")[2] for f in (one, other)))
    least = sorted(a | b)[:KEPT]
    j = sum(x in a and x in b for x in least) / len(least)
    return 2 * j / (1 + j)


def edited(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """own with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(own) // 2
    return np.concatenate((own[: len(own) - half], following[:half]))


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(part, extra, doc_id, tie, text): rows cut into ranges of descending id and tie, each ended by a copy of the next range's first row.

    tie is a hash of the text, so that rows without an id, or with one id, are
    cut too. The ranges come from a job over ids and ties, which returns one of
    each for each part. The text is shuffled once; the row after the last is the
    first of all.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"), F.col(text_col).cast("string").alias("text"))
    ids = rows.select("doc_id", "tie").repartitionByRange(parts, F.desc_nulls_last("doc_id"), F.desc("tie"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def keys(b):
        return [(x is not None, x, t) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]

    def first(batches):
        most = max((max(keys(b)) for b in batches if b.num_rows), default=None)
        if most:
            yield pa.RecordBatch.from_pylist([{"doc_id": most[1], "tie": most[2]}], pa.schema([("doc_id", id_type), ("tie", pa.int64())]))

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    ascending = sorted((r[0] is not None, r[0], r[1]) for r in ids.mapInArrow(first, f"doc_id {kind}, tie long").collect())
    known = np.array([x for has, x, _ in ascending if has])
    exact = set(ascending)

    def deal(batches):
        for b in batches:
            has = np.asarray(b.column(0).is_valid())
            part = np.zeros(b.num_rows, np.int32)
            own = np.asarray(b.column(0).filter(b.column(0).is_valid()))
            if len(known):
                part[has] = len(known) - 1 - np.searchsorted(known, own)  # as many ranges start with a greater id
                has[has] = ~np.isin(own, known)
            near = np.flatnonzero(~has)  # ids that ranges start with, and nulls: the tie decides
            near_keys = keys(pa.RecordBatch.from_arrays([b.column(i).take(pa.array(near)) for i in (0, 1)], ["doc_id", "tie"]))
            part[near] = [len(ascending) - 1 - bisect_left(ascending, k) for k in near_keys]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), np.int32)), *b.columns], names)
            again = near[[k in exact for k in near_keys]] if len(near) else near
            if len(again):
                before = (part[again] - 1) % len(ascending)
                yield pa.RecordBatch.from_arrays([pa.array(before.astype(np.int32)), pa.array(np.ones(len(again), np.int32)), *(c.take(pa.array(again)) for c in b.columns)], names)

    names = ["part", "extra", "doc_id", "tie", "text"]
    dealt = rows.mapInArrow(deal, f"part int, extra int, doc_id {kind}, tie long, text string")
    return dealt.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), F.desc("tie"), F.desc_nulls_last("text"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (likeness() of the fingerprint to the edited text's and
    to the next document's), and common_start (the longest common extension of a
    text and the next from their starts). The next document is the one after it
    by descending id, ties by descending XXH64 of the text; after the last comes
    the first. Null texts are empty; null ids come last of all; a single document
    is its own next. Repeated rows are neighbours and alike. Likeness is 1 for
    equal texts, two empty ones too. Texts of any length are read whole. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    parts = max(shuffle_parts(spark), -(-docs.count() // RANGE))
    rows = with_next(docs, id_col, text_col, parts)

    def run(batches):
        cells: list[tuple] = []
        held = None  # the row that still lacks its next: (part, id, code points, prefixes, fingerprint)
        for b in batches:
            for part, extra, doc_id, _, text in zip(*(c.to_pylist() for c in b.columns)):
                waits = held and held[0] == part
                if extra and not waits:  # the copy of a repeated row, once more
                    continue
                now = points(text)
                hashed = Prefixes(now)
                print_ = hashed.fingerprint()
                if waits:
                    _, own_id, own, mine, known = held
                    change = edited(own, now)
                    new = Prefixes(change).fingerprint()
                    digest = hashlib.sha256(change.tobytes().decode("utf-32-le").encode()).hexdigest()
                    cells.append((own_id, len(own), digest, known, new, likeness(known, new), likeness(known, print_), mine.extension(0, hashed, 0)))
                held = None if extra else (part, doc_id, now, hashed, print_)
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), kinds)], names)
                cells.clear()

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_start"]
    kinds = [to_arrow_type(rows.schema["doc_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long")
