"""Edit-aware token counts: segment trees over the pre-tokens of each document.

A document keeps the bounds of its pre-tokens and a tree of their token counts.
An edit re-encodes only from the first pre-token that it can reach (its own span
and the context the pattern looks at) to the first old bound after it at which
the new split agrees again; sums along the changed leaves' paths are updated.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Pre-tokens in a leaf of the tree; characters the pattern can look ahead besides a run of white space.
LEAF, AHEAD = 32, 3
#: Bytes of pre-tokens that a worker remembers the counts of, with ENTRY for each; beyond that it forgets them all and goes on.
CACHE, ENTRY = 48 << 20, 150


class Counter:
    """Token counts of pre-tokens with one vocabulary; used inside a worker."""

    def __init__(self, packed: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in packed.splitlines() if x.strip())}
        self.match = regex.compile(pattern)
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.seen: dict[str, int] = {}
        self.held = 0

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.seen.__getitem__, pre_tokens), np.int64, len(pre_tokens))
        except KeyError:
            if self.held > CACHE:
                self.seen, self.held = {}, 0
            for p in set(pre_tokens).difference(self.seen):
                self.seen[p] = len(self.encode(p.encode()))
                self.held += ENTRY + 4 * len(p)
        return np.fromiter(map(self.seen.__getitem__, pre_tokens), np.int64, len(pre_tokens))


@lru_cache(2)
def counter(packed: bytes, pattern: str) -> Counter:
    """One counter for each vocabulary and worker process."""
    return Counter(packed, pattern)


class SumTree:
    """Sums over leaves of LEAF pre-tokens each, in one array: node i has children 2i and 2i + 1."""

    def __init__(self, leaves: np.ndarray):
        self.size = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.node = np.zeros(2 * self.size, np.int64)
        self.node[self.size : self.size + len(leaves)] = leaves
        lo = self.size
        while lo > 1:
            self.node[lo // 2 : lo] = self.node[lo : 2 * lo].reshape(-1, 2).sum(1)
            lo //= 2
        self.updated = 0

    def total(self) -> int:
        return int(self.node[1])

    def put(self, leaf: int, value: int) -> None:
        """Set a leaf and the sums above it."""
        i = leaf + self.size
        change = value - self.node[i]
        while i and change:
            self.node[i] += change
            self.updated += 1
            i //= 2

    def prefix(self, leaf: int) -> int:
        """Sum of the leaves before this one."""
        total, i = 0, leaf + self.size
        while i > 1:
            if i & 1:
                total += int(self.node[i - 1])
            i //= 2
        return total


@dataclass
class Segment:
    """Pre-tokens of one leaf: their lengths and token counts."""

    lengths: np.ndarray
    counts: np.ndarray


class Document:
    """A text with its pre-token segments and their tree of token counts."""

    def __init__(self, text: str, coder: Counter):
        self.text, self.coder = text, coder
        pre = coder.match.findall(text)
        lengths = np.fromiter(map(len, pre), np.int64, len(pre))
        counts = coder.count(pre)
        cuts = range(0, max(1, len(pre)), LEAF)
        self.segments = [Segment(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in cuts]
        self._index()
        self.recounted = 0

    def _index(self) -> None:
        self.sums = SumTree(np.array([s.counts.sum() for s in self.segments], np.int64))
        self.chars = SumTree(np.array([s.lengths.sum() for s in self.segments], np.int64))

    def tokens(self) -> int:
        return self.sums.total()

    def _leaf(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where it starts: down the tree of lengths."""
        i, start, tree = 1, 0, self.chars
        if position >= tree.total():
            last = len(self.segments) - 1
            return last, tree.prefix(last)
        while i < tree.size:
            i *= 2
            if position - start >= tree.node[i]:
                start += int(tree.node[i])
                i += 1
        return i - tree.size, start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace text[start:stop] by new; positions outside the text are clipped."""
        start = min(max(0, start), len(self.text))
        stop = min(max(start, stop), len(self.text))
        old, shift = self.text, len(new) - (stop - start)
        text = old[:start] + new + old[stop:]
        reach = max(0, start - AHEAD)
        while reach and (old[reach - 1].isspace() or old[min(reach, len(old) - 1)].isspace()):
            reach -= 1
        # the first pre-token that doesn't end before `reach`
        leaf, at = self._leaf(max(0, reach - 1))
        own = at + np.cumsum(self.segments[leaf].lengths)
        begin = int(own[own < reach][-1]) if (own < reach).any() else at
        # forward: old bounds after the edit, shifted, until the new split meets one of them
        bound, last = at, leaf
        bounds: list[int] = []
        pre: list[str] = []
        where = begin
        meet = None
        while meet is None and where < len(text):
            m = self.coder.match.match(text, where)
            if m is None or m.end() == where:
                break
            pre.append(m.group())
            where = m.end()
            while last < len(self.segments) and (not bounds or bounds[-1] + shift < where):
                ends = bound + np.cumsum(self.segments[last].lengths)
                bounds = ends.tolist()
                bound = bounds[-1] if bounds else bound
                last += 1
            if where - shift >= stop and where - shift in bounds:
                meet = where - shift
        if meet is None:  # to the end of the text
            last, meet = len(self.segments), len(old)
        counts = self.coder.count(pre)
        self.recounted += len(pre)
        # the touched leaves: what stays of the first, the new part, what stays of the last
        first = self.segments[leaf]
        stay = int((at + np.cumsum(first.lengths) <= begin).sum())
        ends = at + np.cumsum(np.concatenate([s.lengths for s in self.segments[leaf:last]]))
        tail = ends > meet
        lengths = np.concatenate((first.lengths[:stay], np.fromiter(map(len, pre), np.int64, len(pre)), np.concatenate([s.lengths for s in self.segments[leaf:last]])[tail]))
        counts = np.concatenate((first.counts[:stay], counts, np.concatenate([s.counts for s in self.segments[leaf:last]])[tail]))
        self.text = text
        leaves = last - leaf
        if len(lengths) <= 2 * LEAF * leaves:  # the leaves take it: only their paths change
            cuts = np.linspace(0, len(lengths), leaves + 1).astype(int)
            for i in range(leaves):
                s = Segment(lengths[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]])
                self.segments[leaf + i] = s
                self.sums.put(leaf + i, int(s.counts.sum()))
                self.chars.put(leaf + i, int(s.lengths.sum()))
        else:
            cuts = range(0, len(lengths), LEAF)
            self.segments[leaf:last] = [Segment(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in cuts]
            self._index()


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text before and after its edits.

    edits is a column: array<struct<start int, stop int, put string>>, in code
    points of the text as the edits before have left it; null or empty: none.
    Returns doc_id, n_tokens, edited_tokens, n_pre_tokens, recounted (pre-tokens
    re-encoded) and nodes_updated (sums changed in the tree). Null texts are
    empty; null entries and null ends of an edit are skipped, a null put deletes.
    Each row of docs gives one row; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), edits.alias("edits"))

    def run(batches):
        coder = counter(shared.value, pattern)
        for b in batches:
            out = []
            for text, changes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                doc = Document(text or "", coder)
                before, pre = doc.tokens(), sum(len(s.lengths) for s in doc.segments)
                updated = 0
                for e in changes or ():
                    if e and e["start"] is not None and e["stop"] is not None:
                        tree = doc.sums
                        was = tree.updated
                        doc.edit(e["start"], e["stop"], e["put"] or "")
                        updated += doc.sums.updated - was if doc.sums is tree else 2 * doc.sums.size
                out.append((before, doc.tokens(), pre, doc.recounted, updated))
            cells = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cells)], names)

    names = ["doc_id", "n_tokens", "edited_tokens", "n_pre_tokens", "recounted", "nodes_updated"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names[1:])]))
