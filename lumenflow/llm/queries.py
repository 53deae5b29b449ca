"""The registered corpus queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenflow.llm import exact_packing, extendible_dedup, license_rules, line_blocks, pii_boost, quality_llr, sp_nbest, subword_classifier, tensor_minhash, warc_split


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_nbest.segment(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.licenses(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_groups(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.find_personal_data(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_split.round_trip(_table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_dedup.exact_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_sentencepiece_nbest": op3_sentencepiece_nbest,
    "op4_license_scan": op4_license_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_warc": op9_warc,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    "op4_license_scan": license_rules.oracle_sql(),
    "op6_minhash_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS items FROM w),
             c AS MATERIALIZED (SELECT min(doc_id) AS c, items, len(items) AS n FROM s WHERE len(items) > 0 GROUP BY items),
             u AS MATERIALIZED (SELECT c, n, unnest(items) AS item FROM c),
             l AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM u a JOIN u b ON a.item = b.item AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
             e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
             m AS (SELECT a AS c, min(b) AS component_id FROM r GROUP BY a),
             k AS (SELECT items, component_id FROM c JOIN m USING (c))
        SELECT doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM s LEFT JOIN k ON s.items = k.items""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM m""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
}
