"""Totals and tallies over files; the files are the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.functions.scalar import token_estimate
from stratalens.registry import query, table


@query(
    "a2_language_tally",
    """
    WITH t AS (
      SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars,
             CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5 + 0.5)) END) AS BIGINT) AS tokens
      FROM documents GROUP BY lang)
    SELECT lang, files, chars, tokens, floor(tokens * 1.0 / sum(tokens) OVER () * 10000 + 0.5) / 10000 AS share FROM t
    """,
)
def language_tally(spark, sf_dir):
    """Files, characters and estimated tokens by language, with the share of all tokens."""
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.sum(token_estimate(F.col("text"))).alias("tokens"))
    share = F.col("tokens") / F.sum("tokens").over(W.partitionBy())
    return t.withColumn("share", F.floor(share * 10000 + 0.5) / 10000)
