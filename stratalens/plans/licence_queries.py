"""Licence expressions made of customers' keys, their headers and risks; the SQL spells out each form's choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import licences as L
from stratalens.joins import dealt
from stratalens.plans.adapters import view
from stratalens.registry import query

#: name, name in a header, rank of its class
NAMES = (("MIT", "MIT", 0), ("gpl-3.0-only", "GPL-3.0-only", 3), ("Foo-1", "Foo-1", 1), ("LicenseRef-closed", "LicenseRef-closed", 2), ("apache-2.0", "Apache-2.0", 0), ("LGPL-2.1+", "LGPL-2.1-or-later", 3), ("ISC", "ISC", 0))


def texts(spark, sf):
    """path, project, text: nine forms of expression by the key."""
    one = lambda k, div: f"element_at(array({', '.join(repr(n[0]) for n in NAMES)}), CAST(floor({k} / {div}) % 7 AS INT) + 1)"
    keys = dealt(view(spark, sf, "SELECT c_custkey, c_nationkey FROM customer"))
    return spark.sql(f"""
      SELECT path, c_nationkey AS project, CASE form WHEN 0 THEN a WHEN 1 THEN concat(a, ' AND ', b) WHEN 2 THEN concat(a, ' or ', b) WHEN 3 THEN concat('(', a, ' OR ', b, ') AND ', c) WHEN 4 THEN concat(a, ' OR ', b, ' AND ', c)
        WHEN 5 THEN concat('((', a, ' and ', b, ') OR ', c, ') AND (', b, ')') WHEN 6 THEN concat(a, ' WITH e-1.0 AND (', b, ' OR ', c, ')') WHEN 7 THEN concat('(', a, ' OR ', b) ELSE concat(a, ' ', b, ' OR') END AS text
      FROM (SELECT concat('f', CAST(c_custkey AS STRING)) AS path, c_nationkey, c_custkey % 9 AS form, {one('c_custkey', 1)} AS a, {one('c_custkey', 7)} AS b, {one('c_custkey', 49)} AS c FROM {{keys}})""", keys=keys)  # fmt: skip


BASE = f"""names(i, name, head, rank) AS (VALUES {', '.join(f"({i}, '{n}', '{h}', {r})" for i, (n, h, r) in enumerate(NAMES))}),
  keys AS (SELECT concat('f', CAST(c_custkey AS VARCHAR)) AS path, c_nationkey AS project, c_custkey % 9 AS form, c_custkey % 7 AS i, c_custkey // 7 % 7 AS j, c_custkey // 49 % 7 AS k FROM customer),
  picked AS (SELECT path, project, form, x.head AS a, y.head AS b, z.head AS c, x.rank AS r, y.rank AS s, z.rank AS t FROM keys JOIN names x ON x.i = keys.i JOIN names y ON y.i = keys.j JOIN names z ON z.i = keys.k),
  offers AS (SELECT *, list_sort(list_distinct(CASE form WHEN 0 THEN [r] WHEN 1 THEN [greatest(r, s)] WHEN 2 THEN [r, s] WHEN 3 THEN [greatest(r, t), greatest(s, t)] WHEN 4 THEN [r, greatest(s, t)]
    WHEN 5 THEN [greatest(r, s), greatest(t, s)] WHEN 6 THEN [greatest(r, s), greatest(r, t)] ELSE [1] END)) AS ranks FROM picked)"""


@query("f7_licence_offers", f"WITH {BASE} SELECT path, array_to_string(list_transform(ranks, lambda x: ['permissive', 'unknown', 'proprietary', 'copyleft'][x + 1]), ',') AS offers FROM offers")
def offers(spark, sf):
    return texts(spark, sf).select("path", F.array_join(L.class_names(L.offer_bits(F.col("text"))), ",").alias("offers"))


@query("f6_header_expression", f"""
  WITH {BASE} SELECT path, CASE form WHEN 0 THEN a WHEN 1 THEN a || ' AND ' || b WHEN 2 THEN a || ' OR ' || b WHEN 3 THEN '(' || a || ' OR ' || b || ') AND ' || c WHEN 4 THEN a || ' OR ' || b || ' AND ' || c
    WHEN 5 THEN '((' || a || ' AND ' || b || ') OR ' || c || ') AND (' || b || ')' WHEN 6 THEN a || ' WITH e-1.0 AND (' || b || ' OR ' || c || ')' ELSE a END AS header FROM offers WHERE regexp_extract(path, '[0-9]+')::BIGINT % 5 <> 0""")  # fmt: skip
def header(spark, sf):
    key = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    # every fifth file has the tag too far down
    top = F.when(key % 5 == 0, F.repeat(F.lit("x\n"), 60)).otherwise("#!/bin/sh\n")
    t = texts(spark, sf).withColumn("text", F.concat(top, F.lit("/* SPDX-License-Identifier: "), "text", F.lit(" */\nSPDX-License-Identifier: Zlib")))
    return t.select("path", L.header_expression(F.col("text")).alias("header")).where("header is not null")


PROJECTS = "SELECT n_nationkey AS project, CASE n_nationkey % 6 WHEN 0 THEN 'MIT OR GPL-3.0-only' WHEN 1 THEN 'SEE LICENSE IN x.txt' WHEN 2 THEN 'Foo-1' WHEN 3 THEN 'GPLv3+' END AS licence, n_nationkey % 6 = 4 AS has_file FROM nation"


@query("f7_licence_risks", f"""
  WITH {BASE}, own AS (SELECT project, licence, has_file, project % 6 AS kind FROM ({PROJECTS}))
  SELECT project, path, CASE kind WHEN 0 THEN 'high' WHEN 1 THEN 'high' ELSE 'medium' END AS severity, CASE kind WHEN 0 THEN 'permissive-project' WHEN 1 THEN 'closed-project' WHEN 2 THEN 'unknown-project' WHEN 4 THEN 'unrecognised-file' ELSE 'undeclared' END AS reason
  FROM offers JOIN own USING (project) WHERE ranks = [3] AND kind <> 3 UNION ALL SELECT project, NULL, 'low', 'no-licence' FROM own WHERE kind = 5""")  # fmt: skip
def risks(spark, sf):
    return L.licence_risks(texts(spark, sf).withColumnRenamed("text", "licence"), view(spark, sf, PROJECTS)).drop("licence")
