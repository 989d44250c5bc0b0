"""The thin queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are source/thousand/doc_id; a document that is as a whole a licence statement, other than a mere reservation of rights, is a notice for its directory."""
    from .licenses import FILE, license_scan

    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return license_scan(table(spark, sf_dir, "documents"), path, F.col("text"), is_notice=(F.col("license") != "Proprietary") & (F.col("kind") == FILE))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    plan = mix(table(spark, sf_dir, "documents"))
    billionths = F.floor(F.col("position") * 1e9).alias("position_e9")
    return plan.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", billionths)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe

    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=False)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: an insertion in the middle, a deletion near the start, a replacement at three quarters."""
    import public_tokenizers

    from .token_counts import count_tokens

    n = F.coalesce(F.char_length("text"), F.lit(0))
    at = lambda share: F.floor(n * share).cast("int")
    edit = lambda start, stop, put: F.struct(start.alias("start"), stop.alias("stop"), put.alias("put"))
    edits = F.array(
        edit(at(0.5), at(0.5), F.lit(" it's an inserted line\n")),
        edit(F.lit(10), F.lit(25), F.lit("")),
        edit(at(0.75), at(0.75) + 40, F.substring("text", 1, 30)),
    )
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, edits)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL: dict[str, str] = {}

SQL["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _position(place: str, share: str) -> str:
    """The SQL of mixing.training_time() for the production schedules, by the weight's place."""
    from .mixing import SCHEDULES

    out = []
    for i, s in enumerate(SCHEDULES):
        area = [0.0]
        for (t0, w0), (t1, w1) in zip(s, s[1:]):
            area.append(area[-1] + (w0 + w1) / 2 * (t1 - t0))
        parts = []
        for k, ((t0, w0), (t1, w1)) in enumerate(zip(s, s[1:])):
            d = f"greatest(0.0::DOUBLE, {share} * {area[-1]!r}::DOUBLE - {area[k]!r}::DOUBLE)"
            root = f"sqrt(greatest(0.0::DOUBLE, {w0 * w0!r}::DOUBLE + {2 * (w1 - w0) / (t1 - t0)!r}::DOUBLE * {d}))"
            parts.append(f"WHEN {share} * {area[-1]!r}::DOUBLE <= {area[k + 1]!r}::DOUBLE OR {k == len(s) - 2} THEN least({t1!r}::DOUBLE, {t0!r}::DOUBLE + 2.0::DOUBLE * {d} / ({w0!r}::DOUBLE + {root}))")
        out.append(f"WHEN {place} % {len(SCHEDULES)} = {i} THEN CASE {' '.join(parts)} END")
    return f"CASE {' '.join(out)} END"


SQL["op3_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS o FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS most FROM s
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r
), g AS (
  SELECT *, most / weight AS ratio FROM w
), u AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(CAST(source_size AS DOUBLE)) OVER () AS total FROM g
), v AS (SELECT *, (total - used) / open AS level FROM u),
t AS (SELECT source, source_size, place, least(most, (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight) AS target FROM v),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place, CAST(floor(t.target + 0.5) AS BIGINT) AS wanted,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS passes, CAST(start AS DOUBLE) / CAST(wanted AS DOUBLE) AS share FROM p
), y AS (SELECT *, size * passes + greatest(0, least(size, wanted - passes * source_size - start)) AS taken FROM x)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN CAST(floor(({_position('place', 'share')}) * 1e9::DOUBLE) AS BIGINT) END AS position_e9
FROM y
"""


def _license_sql() -> str:
    from .licenses import FILE, LINES, PARAGRAPH, TEMPLATES, THRESHOLD

    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '[^0-9a-z]+'), lambda x: x <> '')"
    runs = " UNION ALL ".join(
        f"SELECT path, {n} AS kind, i - 1 AS pos, flatten(list_slice(l, i, i + {n - 1})) AS w FROM (SELECT path, l, unnest(range(1, len(l) - {n - 2})) AS i FROM files WHERE len(l) >= {n}) WHERE len(list_filter(list_slice(l, i, i + {n - 1}), lambda x: len(x) = 0)) = 0"
        for n in range(1, LINES + 1)
    )
    return f"""
WITH tpl(i, license, txt) AS (VALUES {rows}),
tw AS (SELECT i, t, count(*) AS c FROM (SELECT i, unnest({words('lower(txt)')}) AS t FROM tpl) GROUP BY ALL),
vocab AS (SELECT DISTINCT t FROM tw),
docs AS (SELECT concat_ws('/', source, CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path, lower(text) AS x FROM documents),
files AS (SELECT path, x, list_transform(string_split(x, chr(10)), lambda y: {words('y')}) AS l FROM docs),
lines AS (SELECT path, unnest(l) AS w FROM files),
total AS (SELECT count(*) AS n FROM lines WHERE len(w) > 0),
df AS (SELECT t, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS t FROM lines) SEMI JOIN vocab USING (t) GROUP BY t),
units AS (
  {runs}
  UNION ALL SELECT path, {PARAGRAPH}, pos - 1, b[pos] FROM (SELECT path, b, unnest(range(1, len(b) + 1)) AS pos FROM (SELECT path, list_filter(list_transform(regexp_split_to_array(x, '\n[^0-9a-z\n]*\n'), lambda y: {words('y')}), lambda y: len(y) > 0) AS b FROM files))
  UNION ALL SELECT path, {FILE}, 0, flatten(l) FROM files WHERE len(flatten(l)) > 0
),
counts AS (SELECT path, kind, pos, t, count(*) AS c FROM (SELECT path, kind, pos, unnest(w) AS t FROM units) GROUP BY ALL),
idf AS (SELECT t, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 AS w FROM vocab LEFT JOIN df USING (t), total),
vectors AS (SELECT i, t, c * w / sqrt(sum((c * w) ** 2) OVER (PARTITION BY i)) AS u FROM tw JOIN idf USING (t)),
norms AS (
  SELECT path, kind, pos, sqrt(sum((c * coalesce(idf.w, ln(total.n + 1) + 1)) ** 2)) AS norm
  FROM counts LEFT JOIN idf USING (t), total GROUP BY path, kind, pos
),
sims AS (
  SELECT path, kind, pos, i, sum(c * w * u) / any_value(norm) AS s FROM counts JOIN idf USING (t) JOIN vectors USING (t) JOIN norms USING (path, kind, pos) GROUP BY path, kind, pos, i
),
best AS (
  SELECT path, kind, i, s FROM sims WHERE s >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(s, 12) DESC, kind, pos, i) = 1
),
headers AS (SELECT path, license, kind, round(s, 6) AS similarity FROM best JOIN tpl USING (i)),
dirs AS (SELECT path, string_split(path, '/') AS parts FROM (SELECT DISTINCT path FROM docs)),
ups AS (SELECT path, unnest(range(1, len(parts) + 1)) AS up, parts FROM dirs),
above AS (SELECT path, up, array_to_string(list_slice(parts, 1, len(parts) - up), '/') AS dir FROM ups),
notices AS (
  SELECT dir, license AS notice FROM headers JOIN above USING (path) WHERE up = 1 AND license <> 'Proprietary' AND kind = {FILE}
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path) = 1
),
near AS (
  SELECT path, dir, notice FROM above JOIN notices USING (dir) ANTI JOIN headers USING (path) QUALIFY row_number() OVER (PARTITION BY path ORDER BY up) = 1
)
SELECT dirs.path, coalesce(h.license, near.notice) AS license, CASE WHEN h.license IS NOT NULL THEN 'header' WHEN near.notice IS NOT NULL THEN 'directory' ELSE 'none' END AS basis,
  h.similarity, near.dir AS from_dir
FROM dirs LEFT JOIN headers h USING (path) LEFT JOIN near ON near.path = dirs.path
"""


SQL["op1_licenses"] = _license_sql()

SQL["op2_substrings"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, n, p, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS key FROM t),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) > 1 AS later FROM k WHERE p <= n - 19),
m AS (SELECT t.doc_id, t.x, t.p, coalesce(bool_or(later) OVER (PARTITION BY t.doc_id ORDER BY t.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM t LEFT JOIN f ON t.doc_id = f.doc_id AND t.p = f.p),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
