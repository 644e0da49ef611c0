"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, jaccard, language, license_scan, minhash, neighbours, packing, quality, resampling, secret_scan, url_rules, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_ngram_jaccard_join, op3_secret_scans, op4_quality_rules, op5_nearest_neighbours, op6_byte_bpe, op7_url_filters, op8_language_id, op9_best_fit_packing, op10_license_scans, op11_embedding_whitening, op12_importance_resampling, op13_minhash_near_dedup)
    return {f.__name__: f for f in found}


#: All pairs of unlike sets that share a shingle, then smallest ids along links.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w
), k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS class, s FROM s
), c AS (SELECT class, min(doc_id) AS least, any_value(n) AS n, any_value(s) AS s FROM k WHERE class IS NOT NULL GROUP BY class
), t AS (SELECT least AS id, n, unnest(s) AS shingle FROM c
), p AS (SELECT x.id AS a, y.id AS b, count(*) AS c2, any_value(x.n + y.n) AS n FROM t x JOIN t y ON x.shingle = y.shingle AND x.id < y.id GROUP BY x.id, y.id
), e AS (SELECT a, b FROM p WHERE 100 * c2 >= 80 * (n - c2)
), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT least AS node, least AS root FROM c UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.node WHERE r.root < e2.b
), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(m.root, k.doc_id) AS component_id FROM k LEFT JOIN c ON c.class = k.class LEFT JOIN m ON m.node = c.least
"""

#: Distances are summed in the order of dimensions on both sides.
OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

#: CRC-32 by its table of 256 entries over each distinct word's bytes.
OP12_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i))
), w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (SELECT side, id, unnest(ws) AS g FROM w
), h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)
), b AS (
  SELECT g, xor(list_reduce(list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda k: (strpos('0123456789ABCDEF', x[2 * k + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * k + 2]) - 1), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM h, crc
), c AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN b USING (g) GROUP BY bucket
), n AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c
), gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((c.t + 1) * (n.s + 10000) AS DOUBLE) / ((c.s + 1) * (n.t + 10000)))) AS BIGINT) AS gain FROM c, n
), weight AS (SELECT id, count(*) AS n_features, CAST((sum(gain) - ((sum(gain) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weight USING (id) WHERE side = 'd'
), ranked AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FILTER (words >= 20) * 10 // 100 FROM scored) THEN r END AS rank FROM ranked
"""

#: As for op2, with shingles of 3 words and 85 of 100.
OP13_SQL = (
    OP2_SQL.replace("len(w) < 5", "len(w) < 3").replace("len(w) - 3", "len(w) - 1").replace("i + 4", "i + 2").replace("100 * c2 >= 80", "100 * c2 >= 85")
    .replace("AS component_id FROM k", "AS component_id, k.doc_id = coalesce(m.root, k.doc_id) AS kept FROM k")
)


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op5_nearest_neighbours": OP5_SQL, "op12_importance_resampling": OP12_SQL, "op13_minhash_near_dedup": OP13_SQL}
