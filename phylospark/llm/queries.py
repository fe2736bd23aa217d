"""The queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.llm import exact_dedup, html_wrappers, imatch, imatch_sql, langid, licenses, merkle, merkle_sql, mixing, packing, quality, repair, repair_sql, revisits, simhash, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.captures_of_pages(_table(spark, sf_dir, "pages")))
    return found.select("record_id", "response_id", "response_ts", "status", F.col("headers")["content-type"].alias("content_type"), F.col("headers")["date"].cast("long").alias("header_date"), F.md5("payload").alias("payload_md5"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints_and_edits(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLES = {
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
            FROM v AS q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
        SELECT * FROM r WHERE rank <= 20
    """,
    "op8_warc_revisits": r"""
        WITH p AS (SELECT page_id, html, substr(md5(coalesce(html, '')), 1, 16) AS etag,
            regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare FROM pages),
        u AS (SELECT page_id, html, etag,
            regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^(www[0-9]*\.)+', ''), ':(80|443)$', '')
            || regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\.(html?|php)$', '/'), '/+$', '') AS path,
            list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid)(=|$)'))) AS q FROM p),
        c AS (SELECT page_id, html, etag, path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM u),
        a AS (SELECT r.page_id, r.etag, max(s.page_id) AS found FROM c r LEFT JOIN c s ON r.u = s.u AND 2 * s.page_id + 1 < 2 * r.page_id + 901 GROUP BY ALL)
        SELECT 2 * a.page_id + 1 AS record_id, 2 * found AS response_id, 2 * found + 1 AS response_ts,
            CASE WHEN found IS NULL THEN 'missing' WHEN c.etag = a.etag THEN 'resolved' ELSE 'changed' END AS status,
            CASE WHEN c.etag = a.etag THEN 'text/html' END AS content_type,
            CASE WHEN c.etag = a.etag THEN 2 * a.page_id + 901 END AS header_date,
            CASE WHEN c.etag = a.etag THEN md5(c.html) END AS payload_md5
        FROM a LEFT JOIN c ON c.page_id = a.found
    """,
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
        k AS (SELECT bare, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY bare)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.bare) AS text_sha256 FROM t JOIN k ON t.bare = k.bare
    """,
    "op11_merkle_manifest": merkle_sql.SQL,
    "op12_conversation_repair": repair_sql.SQL,
    "op13_document_fingerprints": imatch_sql.SQL,
}
