"""Byte-level BPE with a sentencepiece model that is written directly from a rank file.

Every byte is mapped to one private character, so a vocabulary entry becomes a
piece of as many characters as it has bytes. Its score is its negative rank:
sentencepiece merges the adjacent pair with the best score, leftmost first,
which is the order in which the rank file merges. Normalisation is identity.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Byte b is the character with code point BYTE_BASE + b; none of them is white space or special to sentencepiece.
BYTE_BASE = 0x4E00
#: Bytes of pre-tokens and their ids that a worker remembers, with ENTRY for each; beyond that it forgets them all and goes on.
CACHE, ENTRY = 48 << 20, 200


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto (protobuf wire format); piece i + 1 is the i-th token by rank, piece 0 is unknown."""
    out = [_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, 2))]
    for i, (token, _) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        piece = "".join(chr(BYTE_BASE + b) for b in token).encode()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", float(-i))))
    trainer = _flag(3, 2) + _flag(4, len(ranks) + 1) + _flag(40, 0) + _varint(41 << 3) + b"\xff" * 9 + b"\x01" + _varint(42 << 3) + b"\xff" * 9 + b"\x01" + _varint(43 << 3) + b"\xff" * 9 + b"\x01"
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encode and decode with one vocabulary; used inside a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in self.tokens], "<u4")
        self.whole = {t: struct.pack("<I", ranks[t]) for t in self.tokens}
        self.by_id = {ranks[t]: t for t in self.tokens}
        self.split = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pre_tokens: set[str]) -> None:
        """Remember the ids of pre-tokens: a vocabulary entry is its own id, others are merged by sentencepiece."""
        rest = []
        for p in pre_tokens:
            own = self.whole.get(p.encode())
            if own is None:
                rest.append(p)
            else:
                self.seen[p] = own
        mapped = [p.encode().decode("latin-1").translate(_SHIFT) for p in rest]
        for p, pieces in zip(rest, self.sp.encode(mapped, out_type=int, num_threads=1) if mapped else ()):
            self.seen[p] = self.ids[np.array(pieces, np.int64) - 1].tobytes()
        self.held += sum(ENTRY + 4 * len(p) + len(self.seen[p]) for p in pre_tokens)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pre = self.split(text)
        try:
            return b"".join(map(self.seen.__getitem__, pre))
        except KeyError:
            if self.held > CACHE:
                self.seen, self.held = {}, 0
            self.learn({p for p in pre if p not in self.seen})
        return b"".join(map(self.seen.__getitem__, pre))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SHIFT = {b: BYTE_BASE + b for b in range(256)}


@lru_cache(2)
def _codec(packed: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    return Codec({base64.b64decode(t): int(r) for t, r in (x.split() for x in packed.splitlines() if x.strip())}, pattern)


def bpe(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids,
    ids (array of int) and decoded (string). Null and empty texts have no
    tokens. Texts of any length are read whole: a worker holds one batch of texts
    with their ids, and at most CACHE bytes of remembered pre-tokens besides.
    Every row of docs gives one row; other columns are ignored. The
    vocabulary (a rank file on the driver, bounded by its size) travels with
    the task, so executors need no copy of the file.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        codec = _codec(shared.value, pattern)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            plain = [codec.decode(x) for x in ids]
            out = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
            out += [pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (ids, plain)]
            if keep_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                out += [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([x.decode() for x in plain], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids)
