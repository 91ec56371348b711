"""Engine tables on top of the driver tables; the texts run in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.registry import table

#: customers as files of a source tree
NODES = """
  SELECT concat(lower(c_mktsegment), '/n', CAST(c_nationkey AS STRING), CASE WHEN c_custkey % 11 = 0 THEN '/tests/f' ELSE '/src/f' END, CAST(c_custkey AS STRING), CASE WHEN c_custkey % 7 = 0 THEN '.py' WHEN c_custkey % 13 = 0 THEN '.md' ELSE '.ts' END) AS id,
         c_custkey AS k, concat('f', CAST(c_custkey AS STRING)) AS name, lower(c_mktsegment) AS grp, c_nationkey AS nation,
         CAST(floor(abs(c_acctbal)) AS BIGINT) AS loc, CAST(floor(abs(c_acctbal) * 3) AS BIGINT) AS tokens,
         CASE WHEN c_custkey % 7 = 0 THEN 'Python' WHEN c_custkey % 13 = 0 THEN 'Markdown' ELSE 'TypeScript' END AS language
  FROM customer"""
#: links among them, derived from keys; targets that do not exist drop out
EDGES = f"""
  SELECT a.id AS src, b.id AS dst, e.kind, CASE WHEN e.k % 10 = 0 THEN 'inferred' WHEN e.k % 17 = 0 THEN 'ambiguous' ELSE 'extracted' END AS confidence
  FROM (SELECT k, (k * 3 + nation) % (SELECT max(c_custkey) FROM customer) + 1 AS t, 'import' AS kind FROM ({NODES}) WHERE k % 4 <> 0
        UNION ALL SELECT k, (k + nation * 5 + 7) % (SELECT max(c_custkey) FROM customer) + 1, 'type-import' FROM ({NODES}) WHERE k % 3 = 0
        UNION ALL SELECT k, CAST(floor(k / 2.0) AS BIGINT), 'dynamic-import' FROM ({NODES}) WHERE k % 5 = 0) e
  JOIN ({NODES}) a ON a.k = e.k JOIN ({NODES}) b ON b.k = e.t WHERE a.k <> b.k"""
#: the same links, once a pair
PAIRS = f"SELECT DISTINCT src, dst FROM ({EDGES})"
#: events as an append-only log of agents' actions; line is the place in the log
LOG = """
  SELECT event_id AS line, ts, concat('agent', CAST(user_id % 7 AS STRING)) AS agent, event_type AS action,
         CASE WHEN value < 20 THEN 'failed' WHEN value < 60 THEN 'partial' ELSE 'success' END AS outcome,
         concat('task', CAST(user_id % 50 AS STRING)) AS ckey, value AS confidence, user_id
  FROM events"""
#: two snapshots of one table of files
BASE = "SELECT concat('f', CAST(o_orderkey AS STRING)) AS path, CAST(floor(o_totalprice) AS BIGINT) AS loc, CAST(floor(o_totalprice * 3) AS BIGINT) AS tokens, o_orderpriority AS language, o_orderdate AS mtime FROM orders WHERE o_orderkey % 10 <> 0"
HEAD = "SELECT concat('f', CAST(o_orderkey AS STRING)) AS path, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 5 ELSE 0 END AS loc, CAST(floor(o_totalprice * 3) AS BIGINT) AS tokens, o_orderpriority AS language, o_orderdate AS mtime FROM orders WHERE o_orderkey % 10 <> 1"
#: findings of two runs: a multiset, the same finding may stand several times
RISKS_BASE = "SELECT concat('rule', CAST(l_partkey % 40 AS STRING)) AS rule, concat('f', CAST(l_orderkey % 500 AS STRING)) AS file, l_returnflag AS category, CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 35 THEN 'high' WHEN l_quantity > 15 THEN 'medium' ELSE 'low' END AS severity, l_orderkey * 10 + l_linenumber AS line FROM lineitem WHERE l_suppkey % 3 <> 0"
RISKS_HEAD = RISKS_BASE.replace("l_suppkey % 3 <> 0", "l_suppkey % 4 <> 0")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over the driver tables it names; sf_dir is bound when the text is analysed."""
    for n in TABLES:
        if n in text:
            table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(text)
