"""Event log queries; the log is the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalens.operators import log as L
from stratalens.plans.adapters import LOG, view
from stratalens.registry import query
from stratalens.sources.readers import read_events
from stratalens.storage import shared_dir

T = f"log AS ({LOG})"


@query("r4_query_log", f"WITH {T} SELECT line, ts, agent, action, outcome FROM log WHERE agent = 'agent3' AND outcome = 'success' AND ts >= TIMESTAMP '2020-01-01 00:00:00' ORDER BY ts DESC, line LIMIT 200")
def query_log(spark, sf):
    return L.query_log(view(spark, sf, LOG), since="2020-01-01 00:00:00", agent="agent3", outcome="success").select("line", "ts", "agent", "action", "outcome")


@query("w1_latest_by_key", f"WITH {T} SELECT action, ckey, line, ts, outcome FROM (SELECT *, row_number() OVER (PARTITION BY action, ckey ORDER BY ts DESC, line) AS n FROM log) WHERE n = 1")
def latest(spark, sf):
    return L.latest_by_key(view(spark, sf, LOG)).select("action", "ckey", "line", "ts", "outcome")


@query("r5_open_items", f"WITH {T}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY action, ckey ORDER BY ts DESC, line) AS n FROM log WHERE action IN ('view', 'click')) WHERE n = 1), a AS (SELECT * FROM n WHERE action = 'view'), c AS (SELECT * FROM n WHERE action = 'click') SELECT a.ckey, a.ts FROM a LEFT JOIN c ON a.ckey = c.ckey WHERE c.ckey IS NULL OR NOT (c.ts > a.ts OR (c.ts = a.ts AND c.line > a.line))")
def opened(spark, sf):
    return L.open_items(view(spark, sf, LOG), "view", "click")


@query("w2_recent_entities", f"WITH {T} SELECT ckey, max(ts) AS last FROM log GROUP BY ckey ORDER BY last DESC, ckey LIMIT 20")
def recent(spark, sf):
    return L.recent_entities(view(spark, sf, LOG), "ckey")


@query("w3_last_served", f"WITH {T} SELECT agent, ckey, ts FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, line) AS n FROM log WHERE action = 'purchase') WHERE n = 1")
def served(spark, sf):
    return L.last_served(view(spark, sf, LOG), "purchase")


@query("r6_close_target", f"WITH {T} SELECT ckey, max(ts) AS ts FROM log WHERE ckey = 'task7' GROUP BY ckey")
def close(spark, sf):
    items = view(spark, sf, LOG).groupBy("ckey").agg(F.max("ts").alias("ts")).withColumn("text", F.concat(F.lit("text of "), F.col("ckey")))
    return L.close_target(items, "task7").select("ckey", "ts")


@query("r7_validate_events", f"WITH {T} SELECT CASE WHEN NOT coalesce(confidence / 90, 0) BETWEEN 0 AND 1 THEN 'confidence is out of range' ELSE 'valid' END AS reason, count(*) AS n FROM log GROUP BY 1")
def valid(spark, sf):
    log = view(spark, sf, LOG).withColumn("confidence", F.col("confidence") / 90).withColumn("reasoning", F.lit(None).cast("string"))
    return L.validated(log).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("r8_sessions", f"""WITH {T}, g AS (SELECT agent, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY agent ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM log), s AS (SELECT agent, ts, sum(first) OVER (PARTITION BY agent ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT agent, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY agent, k""")  # fmt: skip
def sessions(spark, sf):
    return L.sessions(view(spark, sf, LOG), "agent")


@query("a22_recent_ring", f"WITH {T} SELECT agent, line, action FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, line) AS n FROM log) WHERE n <= 50")
def ring(spark, sf):
    return L.ring(view(spark, sf, LOG), "agent", 50).select("agent", "line", "action")


@query("a22_counters", f"WITH {T} SELECT action, outcome, count(*) AS n, count(DISTINCT agent) AS agents FROM log GROUP BY action, outcome")
def counters(spark, sf):
    return L.counters(view(spark, sf, LOG))


#: the log as JSON lines; some are blank, broken or lack a field
JSON_LINES = """SELECT CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN concat('{broken ', CAST(event_id AS STRING)) WHEN event_id % 10 = 2 THEN '{"agent":"a"}'
  ELSE concat('{"timestamp":"2024-01-01T00:00:00Z","action":"', event_type, '","agent":"agent', CAST(user_id % 7 AS STRING), '","confidence":0.5}') END AS value FROM events"""


@query("s8_read_events", "SELECT event_type AS kind, concat('agent', CAST(user_id % 7 AS STRING)) AS detail, count(*) AS n FROM events WHERE event_id % 10 > 2 GROUP BY 1, 2 UNION ALL SELECT 'error', CASE event_id % 10 WHEN 1 THEN 'not JSON' ELSE 'schema' END, count(*) FROM events WHERE event_id % 10 IN (1, 2) GROUP BY 1, 2")
def read_log(spark, sf):
    path = f"{shared_dir(spark)}/stratalens/log-{uuid.uuid4().hex}"
    view(spark, sf, JSON_LINES).write.text(path)
    events, errors = read_events(spark, path)
    return events.groupBy(F.col("action").alias("kind"), F.col("agent").alias("detail")).agg(F.count("*").alias("n")).unionAll(errors.groupBy(F.lit("error"), "reason").agg(F.count("*")))
