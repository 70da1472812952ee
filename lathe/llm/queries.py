"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import decontaminate, fingerprints, htmltext, licenses, minhash, mixing, pii, toxicity, urls, warc
from lathe.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


#: The key of the registered queries; production keys belong in a secret store.
PII_KEY = "lathe"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.checked(pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)).selectExpr("doc_id", "CAST(size(pii) AS BIGINT) AS n_entities", "concat_ws(',', pii.kind) AS kinds", "text")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).selectExpr("page_id", "host", "path", "rule", "verdict", "concat_ws(' ', words) AS words", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontaminate, op2_warc, op3_licenses, op4_toxicity, op5_minhash, op6_fingerprints, op7_html_text, op8_pii, op9_mix, op10_urls, pipeline)
    return {f.__name__: f for f in own}


_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN CAST(first AS BIGINT) END AS refers_to
FROM f
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS s, md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents
), s AS (
  SELECT s, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum((2 * source_size)::DOUBLE) OVER (ORDER BY (2 * source_size)::DOUBLE / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY (2 * source_size)::DOUBLE / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT s, source_size, least((2 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM l
), b AS (
  SELECT floor(sum(target) + 1e-6)::BIGINT AS budget FROM t
), q AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.s ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.s = t.s
), e AS (
  SELECT q.*, i, (upto + i * source_size)::DOUBLE / target AS finish FROM q, range(2) AS r(i) WHERE size > 0
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, s, k, size, i ROWS UNBOUNDED PRECEDING) AS through FROM e
), m AS (
  SELECT doc_id, k, s, size, sum(greatest(0, least(size, budget - (through - size)))) AS taken FROM g, b GROUP BY doc_id, k, s, size
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(m.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN m ON q.doc_id = m.doc_id AND q.k = m.k AND q.s = m.s AND q.size = m.size
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle
  FROM w
), c AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(md5(shingle), '' ORDER BY md5(shingle))) AS whole FROM s GROUP BY doc_id
), r AS (
  SELECT min(doc_id) AS node, any_value(n) AS n, whole FROM c GROUP BY whole
), t AS (
  SELECT node, n, shingle FROM r JOIN s ON s.doc_id = r.node
), x AS (
  SELECT a.node AS a, b.node AS b, a.n AS n, b.n AS m, count(*) AS shared
  FROM t a JOIN t b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), e AS (
  SELECT a, b FROM x WHERE 100 * shared >= 80 * (n + m - shared)
), g AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), p(node, reach) AS (
  SELECT node, node FROM r UNION SELECT p.node, g.b FROM p JOIN g ON p.reach = g.a
), l AS (
  SELECT node, min(reach) AS label FROM p GROUP BY node
)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(l.label, d.doc_id) AS component_id, coalesce(l.label, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN r ON r.whole = c.whole LEFT JOIN l ON l.node = r.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _WARC, "op5_minhash": _NEAR, "op9_mix": _MIX}
