"""The queries of this subpackage and their SQL, for the registry at the top of the repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyweft.llm import bm25_wand, bpe_tree, fim_scan, host_reputation, html_maxsub, merkle_manifest, minhash_join, pii_semicrf, pu_quality, secret_dfa, tiff_media, token_offsets, voronoi_knn

#: Width of shingles that the contract of near-duplicates sets.
SHINGLE_WORDS = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_media(spark, sf_dir):
    return tiff_media.text_media(_table(spark, sf_dir, "documents"))


def op2_secret_automaton(spark, sf_dir):
    return secret_dfa.find_secrets(_table(spark, sf_dir, "documents"))


def op3_html_main_text(spark, sf_dir):
    return html_maxsub.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark, sf_dir):
    return minhash_join.near_duplicates(_table(spark, sf_dir, "documents"), width=SHINGLE_WORDS)


def op5_token_attribution(spark, sf_dir):
    return token_offsets.section_tokens(_table(spark, sf_dir, "documents"))


def op6_bm25_decontamination(spark, sf_dir):
    return bm25_wand.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_bpe_tree(spark, sf_dir):
    return bpe_tree.encoding_digests(_table(spark, sf_dir, "documents"))


def op8_host_reputation(spark, sf_dir):
    return host_reputation.filter_urls(_table(spark, sf_dir, "pages"))


def op9_pii_semicrf(spark, sf_dir):
    return pii_semicrf.find_personal_data(_table(spark, sf_dir, "documents"))


def op10_pu_quality(spark, sf_dir):
    return pu_quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_voronoi_knn(spark, sf_dir):
    return voronoi_knn.embedding_neighbours(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest.document_manifest(_table(spark, sf_dir, "documents"))


def op13_fim_scan(spark, sf_dir):
    return fim_scan.fim_digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_tiff_media, op2_secret_automaton, op3_html_main_text, op4_minhash_near_dedup, op5_token_attribution, op6_bm25_decontamination, op7_bpe_tree, op8_host_reputation, op9_pii_semicrf, op10_pu_quality, op11_voronoi_knn, op12_merkle_manifest, op13_fim_scan)}

NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{host_reputation.UPPER}', '{host_reputation.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') for i in range(1, len(w) - {SHINGLE_WORDS - 2})]) END AS s
  FROM worded
), posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM posted a JOIN posted b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT reach.doc_id, links.y AS other FROM reach JOIN links ON reach.other = links.x
), component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT sets.doc_id, cast(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN component ON sets.doc_id = component.doc_id
"""

ORACLE_SQL = {
    "op4_minhash_near_dedup": NEAR_DUPLICATES_SQL,
    "op8_host_reputation": host_reputation.verdict_sql("pages"),
    "op11_voronoi_knn": voronoi_knn.neighbours_sql("embeddings"),
    "op12_merkle_manifest": merkle_manifest.manifest_sql("documents"),
    "op13_fim_scan": fim_scan.digests_sql("documents"),
}
