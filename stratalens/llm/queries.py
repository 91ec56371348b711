"""The numbered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .dac import dac_digest, read_dac, write_dac
from .html_blocks import block_model, extract
from .langid import language, language_model
from .licenses import document_files, licences
from .mixing import mix
from .packing import INSTRUCTION_LIMITS, pack_digest
from .quality import quality
from .simhash import simhash_components
from .spelling import variants
from .substrings import dedup_substrings
from .toxicity import toxicity, toxicity_model
from .util import shared_dir, table
from .whitening import whiten


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, block_model(pages))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(document_files(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language(docs, language_model(docs))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), **INSTRUCTION_LIMITS)


def op8_directly_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/stratalens/dac-{uuid.uuid4().hex}"
    write_dac(table(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"))
    return dac_digest(read_dac(spark, path))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


#: windows as texts, the smallest document of each, and the words no such window covers, one row a word
SUBSTRING_SQL = r"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows_ AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM rows_ WHERE len(ws) >= 13)),
least_ AS (SELECT k, min(doc_id) AS m FROM windows_ GROUP BY k HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i FROM windows_ JOIN least_ USING (k) WHERE doc_id > m OR (doc_id IS NULL AND m IS NOT NULL)), (SELECT unnest(range(0, 13)) AS j)),
words_ AS (SELECT r, p, ws[p] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM rows_)),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM words_ ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM rows_ LEFT JOIN kept USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_license_scans, op4_language_id, op5_nearest_neighbours, op6_quality_rules, op7_packing, op8_directly_addressable_codes, op9_simhash_near_dedup, op10_mix_to_weights, op11_embedding_whitening, op12_spelling_variants, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    """Only repeated windows are wholly expressible in SQL; tests/llm hold the other queries against brute force."""
    return {"op13_substring_dedup": SUBSTRING_SQL}
