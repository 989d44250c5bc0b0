"""Substring dedup, encoding, token counts, fingerprints and SimHash against brute force."""

import base64
import hashlib
import os
import random
import re
from collections import Counter as Multiset

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from shotloom.llm import bpe, near, queries, simhash, spans, substrings, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def kept_words(rows, window):
    """(id, text) -> words, kept words; ids None last; windows of one id are compared as one document."""
    order = lambda i: (i is None, i or 0)
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, split):
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, ((True, 1 << 62), 0)), (order(i), p))
    out = []
    for (i, _), w in zip(rows, split):
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (order(i), p):
                keep[p : p + window] = [False] * window
        out.append((i, len(w), " ".join(x for x, k in zip(w, keep) if k)))
    return Multiset(out)


def test_substrings(awkward, empty, sample, spark):
    rng = random.Random(3)
    small = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 120)))) for i in range(40)]
    for df, kw in ((awkward, {}), (empty, {}), (sample, {}), (spark.createDataFrame(small, "doc_id long, text string"), {"window": 8, "anchor": 3})):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = substrings.dedup_substrings(df, **kw).collect()
        assert Multiset((r["doc_id"], r["n_words"], r["kept"]) for r in got) == kept_words(rows, kw.get("window", 20))
        assert all(r["n_removed"] == r["n_words"] - len(r["kept"].split(" ")) + (not r["kept"]) for r in got)


def spans_of(spark, rows):
    """The spans that copies() finds, as (row of the copy, start, windows, row of the source, its start), rows by place in the list."""
    df = spark.createDataFrame([(r, i, t) for r, (i, t) in enumerate(rows)], "r long, id long, text string")
    return sorted(tuple(r) for r in substrings.copies(df, 20, 6).collect())


def test_long_copies_are_one_span_each(spark):
    """Nonbranching paths compact: a copy of a passage is one span on one diagonal, whatever stands around it; words decide, not hashes."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = words(300), words(60)
    rows = [(1, words(50) + passage + words(40)), (2, words(7) + passage + words(3)), (3, passage[:120] + words(30) + other), (4, words(25) + other + words(9) + passage[100:160])]
    got = spans_of(spark, [(i, " ".join(t)) for i, t in rows])
    assert got == [(1, 7, 281, 0, 50), (2, 0, 101, 0, 50), (3, 25, 41, 2, 150), (3, 94, 41, 0, 150)]


def test_repeated_rows_stay_linear(spark):
    text = " ".join(f"v{i}" for i in range(120))
    assert spans_of(spark, [(5, text)] * 1000) == []
    got = spans_of(spark, [(i, text) for i in range(1000)])
    assert [(r, start, n, source) for r, start, n, source, _ in got] == [(i, 0, 101, 0) for i in range(1, 1000)]


def test_spans_agree_by_their_words():
    data = " ".join(["x", "a b c d e", "y z", "a b c d e", "a b q d e"]).encode()
    words = substrings.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    sums = lambda i, j: tuple(words.prefixes(0, np.array([i, j])).tolist())
    assert substrings.agree(1, sums(1, 6), 8, sums(8, 13)) and substrings.agree(8, sums(8, 13), 1, sums(1, 6))
    assert not substrings.agree(1, sums(1, 6), 13, sums(13, 18)) and not substrings.agree(0, sums(0, 5), 1, sums(1, 6))


def test_substrings_keep_layout_and_columns(awkward):
    rows = substrings.dedup_substrings(awkward, carry=["lang"], layout=True).where("doc_id = 6").collect()
    assert [(r["lang"], r["kept"]) for r in rows] == [("de", "12 34 !?")]


def test_bpe(awkward, empty, sample, encoding):
    for df in (awkward, empty, sample):
        want = Multiset()
        for r in df.collect():
            ids = encoding.encode_ordinary(r["text"] or "")
            want[(r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r["text"] or ""), tuple(ids), r["text"] or "")] += 1
        got = bpe.bpe(df, PATH, public_tokenizers.PATTERN).collect()
        assert Multiset((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]), r["decoded"]) for r in got) == want


def test_bpe_codec_on_odd_text(encoding, monkeypatch):
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "CACHE", 10_000)
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(0x180), 0x300, 0x660, 0x85, 0xA0, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0xFEFF]]
    for _ in range(2000):
        t = "".join(rng.choices(pool, k=rng.randint(0, 40)))
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t) and codec.decode(ids) == t.encode()
        assert codec.held <= 10_000 + 300 * (40 + 4)
    for k in range(30):  # long pre-tokens count by their bytes
        codec.encode("x" * (3_000 + k))
        assert len(codec.seen) <= 10_000 // 3_000 + 2


def test_segment_trees(encoding):
    coder = token_counts.counter(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for k in range(400):
        text = "".join(rng.choices("ab é'srtvelm \n\t1!.", k=rng.randint(0, 400 if k % 4 else 4000)))
        doc = token_counts.Document(text, coder)
        for _ in range(4):
            a = rng.randint(-2, len(text) + 2)
            b, put = a + rng.choice([0, 0, 1, 3, 50]), "".join(rng.choices("ab 's\n1!", k=rng.choice([0, 1, 5, 300])))
            doc.edit(a, b, put)
            a = min(max(0, a), len(text))
            text = text[:a] + put + text[min(max(a, b), len(text)) :]
            assert doc.text == text and doc.tokens() == len(encoding.encode_ordinary(text))
            assert np.concatenate([s.lengths for s in doc.segments]).tolist() == [len(p) for p in coder.match.findall(text)]
        assert sum(int(s.counts.sum()) for s in doc.segments[:3]) == doc.sums.prefix(min(3, len(doc.segments))) or len(doc.segments) < 4


def test_token_counts(awkward, empty, sample, encoding):
    edit = lambda a, b, put: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(put).cast("string").alias("put"))
    edits = F.array(edit(3, 9, " new's\n"), edit(None, 1, "x"), edit(0, 2, None))
    for df in (awkward, empty, sample):
        want = Multiset()
        for r in df.collect():
            t = r["text"] or ""
            new = (t[:3] + " new's\n" + t[9:])[2:]
            want[(r["doc_id"], len(encoding.encode_ordinary(t)), len(encoding.encode_ordinary(new)))] += 1
        got = token_counts.count_tokens(df, PATH, public_tokenizers.PATTERN, edits).collect()
        assert Multiset((r["doc_id"], r["n_tokens"], r["edited_tokens"]) for r in got) == want
    big = [r for r in token_counts.count_tokens(awkward, PATH, public_tokenizers.PATTERN, edits).collect() if r["n_pre_tokens"] > 10_000]
    assert big and all(r["recounted"] < 20 for r in big)


def test_span_hashes():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(2))
        p, q = (spans.Prefixes(spans.points(x)) for x in (a, b))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert p.extension(i, q, j) == n
        n = 0
        while n < min(len(a), len(b)) and a[len(a) - 1 - n] == b[len(b) - 1 - n]:
            n += 1
        assert p.extension_back(q) == n
        assert (p.fingerprint() == q.fingerprint()) == (a == b) and (p.likeness(q) == 1) == (a == b)


def plain_print(text):
    """The fingerprint by the definition, in Python's integers: (length, whole hash, smallest span hashes)."""
    c = [ord(x) + 1 for x in text]
    h = lambda k, i, j: sum(x * pow(spans.BASES[k], n, spans.PRIMES[k]) for n, x in enumerate(c[i:j])) % spans.PRIMES[k]
    cuts = [i for i in range(len(c) - spans.CUT + 1) if h(0, i, i + spans.CUT) % spans.EVERY == 0]
    bounds = sorted({0, *cuts, len(c)})
    found = np.array([h(0, i, j) << 31 | h(1, i, j) for i, j in zip(bounds, bounds[1:])], np.uint64)
    return len(c), h(0, 0, None) << 32 | h(1, 0, None), sorted({int(x) >> 32 for x in substrings.mix64(found)})[: spans.KEPT]


def test_fingerprints_against_plain_hashes():
    rng = random.Random(12)
    texts = ["", "a", "ab" * 40, "".join(rng.choices("abc dé日", k=700)), "".join(rng.choices("abcdefgh \U0001F600", k=2500))]
    texts += [texts[4][:1200] + texts[3] + texts[4][1200:], texts[3] + "!", texts[4][::-1]]
    plain = [plain_print(t) for t in texts]
    got = [spans.Prefixes(spans.points(t)).fingerprint() for t in texts]
    for (n, whole, kept), f in zip(plain, got):
        a, b, c = f.split("-")
        assert int(a, 16) == n and int(b or "0", 16) == whole and [int(c[i : i + 8], 16) for i in range(0, len(c), 8)] == kept
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            both = sorted({*plain[i][2], *plain[j][2]})[: spans.KEPT]
            share = sum(h in plain[i][2] and h in plain[j][2] for h in both) / max(1, len(both))
            want = 1.0 if x == y else 2 * share / (1 + share)
            assert spans.likeness(got[i], got[j]) == want
    near = lambda i, j: spans.likeness(got[i], got[j])
    assert near(4, 5) > 0.4 and near(3, 6) > 0.8 and near(4, 7) < 0.1 and near(3, 4) < 0.1


def test_document_fingerprints(awkward, empty, sample):
    for df in (awkward, empty, sample, sample.limit(1), awkward.where("doc_id is null")):
        tie = lambda t: 42 if t is None else np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
        rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])), reverse=True)
        want = Multiset()
        for k, (i, t) in enumerate(rows):
            t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
            half = len(t) // 2
            new = t[: len(t) - half] + n[:half]
            prints = [spans.Prefixes(spans.points(x)).fingerprint() for x in (t, new, n)]
            want[(i, len(t), sha(new), *prints[:2], spans.likeness(*prints[:2]), spans.likeness(prints[0], prints[2]), len(os.path.commonprefix([t, n])))] += 1
        got = spans.document_fingerprints(df)
        assert Multiset(tuple(r) for r in got.collect()) == want


def test_ranges_are_even(spark):
    """Rows without an id, and many parts: every part is dealt alone, none more than twice the mean."""
    rows = [(i if i % 3 else None, f"text {i}") for i in range(12_000)]
    df = spans.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 51)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 51 and sum(sizes) == 12_051 and max(sizes) < 2 * 12_051 / 51


def plain_fingerprint(text, k=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(awkward, empty, sample):
    for df in (awkward, empty, sample):
        rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
        group = list(range(len(rows)))
        for i, (_, f) in enumerate(rows):
            for j, (_, g) in enumerate(rows[:i]):
                if (f ^ g).bit_count() <= 2 and group[i] != group[j]:
                    old, new = group[i], group[j]
                    group = [new if x == old else x for x in group]
        least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
        got = simhash.simhash_groups(df).collect()
        assert Multiset((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Multiset((i, f, least[g]) for (i, f), g in zip(rows, group))


@pytest.mark.parametrize("shard, leaf, level", [(64, 8, 12), (16, 4, 12), (16, 4, 2)])
def test_vantage_point_search_loses_no_link(spark, monkeypatch, shard, leaf, level):
    """Dense balls and far points, over many shards; with trees of 2 levels shards are cut again and again."""
    monkeypatch.setattr(simhash, "LEVEL", level)
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for c in centres for _ in range(15)]
    fps = np.unique(np.array(fps + list(rng.integers(0, 1 << 64, 600, dtype=np.uint64)), np.uint64))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    want = simhash.forest(len(fps), a[a != b], b[a != b])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    largest = []
    monkeypatch.setattr(simhash, "stored", lambda d, name: largest.append(d.where("home").groupBy("shard").count().agg({"count": "max"}).head()[0]) or d)
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = simhash.links(df, 2).collect()
    assert len(largest) == {12: 0, 2: 3}[level] and (not largest or largest[-1] < 2 * shard < largest[0])
    u, v = np.array([at[r["u"]] for r in got]), np.array([at[r["v"]] for r in got])
    assert (np.bitwise_count(fps[u] ^ fps[v]) <= 64).all() and (simhash.forest(len(fps), u, v) == want).all()


def likeness_groups(texts):
    """Position -> smallest position of its component, for Jaccard >= 0.8 of five-word shingle sets."""
    sets = []
    for t in texts:
        words = (t or "").encode().translate(simhash.LOWER).split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    label, holders, pairs = list(range(len(sets))), {}, set()
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Multiset((i, j) for own in holders.values() for n, j in enumerate(own) for i in own[:n])
    for (i, j), k in shared.items():
        if 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
            pairs.add((i, j))
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label, pairs


def test_near_groups_against_brute_force(spark, monkeypatch):
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(2)
    base = rng.choices("abcdefghijklmnopqrstuvwxyz", k=90)
    dense = [" ".join(rng.choice(base) if rng.random() < 0.02 else w for w in base) for _ in range(60)]
    for texts, turns in ((rows, near.TURNS), (dense, 0), (dense, near.TURNS)):
        monkeypatch.setattr(near, "TURNS", turns)
        label, pairs = likeness_groups(texts)
        got = near.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label)) and len(got) == len(texts) and pairs
        # what a SimHash radius of 2 leaves apart
        assert any((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 2 for i, j in pairs)
