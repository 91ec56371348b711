"""Text scanners and functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import scalar as S
from stratalens.operators import rollup as R
from stratalens.plans.adapters import view
from stratalens.registry import query, table

TOKENS = "CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5 + 0.5)) END AS BIGINT)"


@query("f1_token_estimate", f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query("a1_totals", f"SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS loc, CAST(sum({TOKENS}) AS BIGINT) AS tokens, count(*) AS files FROM documents")
def totals(spark, sf):
    d = table(spark, sf, "documents").select(F.size(F.split("text", "\n")).cast("long").alias("loc"), S.token_estimate(F.col("text")).alias("tokens"))
    return R.totals(d)


@query("a3_language_share", "SELECT lang, n, floor(n * 1.0 / sum(n) OVER () * 10000 + 0.5) / 10000 AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def share(spark, sf):
    return R.share_of(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), "n")


#: source texts with a marker on some lines, several on one, and more than fifty in a text
MARKED = "SELECT c_custkey AS k, concat('line', chr(10), '# TODO: item ', CAST(c_custkey AS STRING), ' FIXME too', chr(10), 'todo no', chr(10), CASE WHEN c_custkey % 3 = 0 THEN 'x // HACK' ELSE 'TODOS' END, chr(10), repeat(concat('NOTE n', chr(10)), CAST(c_custkey % 60 AS INT))) AS text FROM customer"


@query("f2_marker_lines", """
  SELECT k, CAST(2 AS INTEGER) AS line, 'TODO' AS kind, concat('item ', CAST(k AS STRING), ' FIXME too') AS text FROM (SELECT c_custkey AS k FROM customer) UNION ALL SELECT c_custkey, 4, 'HACK', '' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT k, CAST(4 + i AS INTEGER), 'NOTE', 'n' FROM (SELECT c_custkey AS k, unnest(range(1, CAST(least(c_custkey % 60, CASE WHEN c_custkey % 3 = 0 THEN 48 ELSE 49 END) AS BIGINT) + 1)) AS i FROM customer)""")  # fmt: skip
def markers(spark, sf):
    """First marker of each line, at most 50 lines a text."""
    return view(spark, sf, MARKED).select("k", F.explode(S.todo_hits(F.col("text"))).alias("h")).select("k", "h.line", "h.kind", "h.text")


STOPS = "'add', 'new', 'fix', 'the', 'and', 'for', 'with', 'this', 'that', 'from', 'into', 'make', 'update', 'change', 'create', 'remove', 'delete', 'support', 'using', 'feature', 'refactor', 'implement', 'want', 'need', 'please', 'should', 'could', 'would', 'when', 'where', 'what', 'file', 'files', 'use'"


@query("f3_query_tokens", f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda x: length(x) >= 3 AND x NOT IN ({STOPS})), ',') AS tokens FROM (SELECT item_id, concat('How does the user use new files ', text) AS text FROM benchmark)")
def question(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(S.query_tokens(F.concat(F.lit("How does the user use new files "), "text")), ",").alias("tokens"))


@query("f4_identifier_words", "SELECT c_custkey, array_to_string(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: length(x) >= 3), ',') AS words FROM customer")
def identifiers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.array_join(S.identifier_words(F.col("c_name")), ",").alias("words"))


@query("f5_word_hits", "SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda x: starts_with(x, 'wid'))) > 0")
def hits(spark, sf):
    return table(spark, sf, "part").where(S.word_hit(F.split(F.lower("p_name"), " "), F.lit("wid"))).select("p_partkey", "p_name")


CASES = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in S.LICENSE_PATTERNS)


@query("f8_license_detection", f"SELECT doc_id, CASE {CASES} END AS licence FROM (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def licence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.license_of(F.col("text")).alias("licence"))


@query("f9_license_risk", f"SELECT risk, count(*) AS n FROM (SELECT CASE WHEN l IN ('AGPL-3.0', 'GPL-3.0', 'GPL-2.0') THEN 'high' WHEN l IN ('LGPL-3.0', 'LGPL-2.1', 'LGPL-2.0', 'MPL-2.0') THEN 'medium' WHEN l IS NULL OR l IN ('BSL-1.0', 'CC0-1.0') THEN 'low' ELSE 'none' END AS risk FROM (SELECT CASE {CASES} END AS l FROM (SELECT lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents))) GROUP BY risk")
def licence_risk(spark, sf):
    from stratalens.operators.security import license_risk

    return table(spark, sf, "documents").select(F.coalesce(license_risk(S.license_of(F.col("text"))), F.lit("none")).alias("risk")).groupBy("risk").agg(F.count("*").alias("n"))


@query("f36_secret_scan", """SELECT doc_id, 'generic-secret' AS rule, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:token|secret|api_key|password)\\s*[:=]\\s*"[A-Za-z0-9_/+-]{16,}"')) AS v FROM documents) GROUP BY doc_id""")
def secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(S.secret_hits(F.col("text"))).alias("h")).groupBy("doc_id", F.col("h.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("f36_secret_digest", """SELECT doc_id, substr(sha256(concat('generic-secret', v)), 1, 12) AS digest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:token|secret|api_key|password)\\s*[:=]\\s*"[A-Za-z0-9_/+-]{16,}"')) AS v FROM documents)""")
def digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(S.secret_hits(F.col("text"))).alias("h")).select("doc_id", S.secret_digest(F.col("h.rule"), F.col("h.value")).alias("digest"))


@query("f36_redaction", """SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(?:token|secret|api_key|password)\\s*[:=]\\s*"[A-Za-z0-9_/+-]{16,}"', '[redacted]', 'g')) AS digest FROM documents""")
def redacted(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.redact_secrets(F.col("text"))).alias("digest"))


@query("f37_scrub", """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '(/home/|/Users/|C:\\\\Users\\\\)[^/\\\\\\s]+', '\\1[user]', 'g')) AS digest FROM documents""")
def scrubbed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.scrub(F.col("text"))).alias("digest"))


@query("f23_html_structure", """SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6]\\b')) AS headings, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS links, len(regexp_extract_all(html, '(?i)<p\\b')) AS paragraphs, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_structure(spark, sf):
    return S.html_structure(table(spark, sf, "pages"), "page_id", "html")


@query("f23_html_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(S.html_links(F.col("html"))).alias("href"))


@query("f22_slug_first_sentence", """SELECT page_id, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("f25_path_parts", """SELECT page_id, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(p, '([^/]*)$', 1) AS base, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS p FROM pages)""")
def paths(spark, sf):
    p = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", S.dirname(p).alias("dir"), S.basename(p).alias("base"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("a7_tree_rollup", """
  WITH f AS (SELECT regexp_extract(p, '^(.*)/[^/]*$', 1) AS d, length(html) AS n FROM (SELECT html, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS p FROM pages)),
  a AS (SELECT array_to_string(string_split(d, '/')[1:k], '/') AS dir, n FROM (SELECT d, n, unnest(range(1, len(string_split(d, '/')) + 1)) AS k FROM f WHERE d <> '') UNION ALL SELECT '', n FROM f)
  SELECT dir, CAST(sum(n) AS BIGINT) AS chars, count(*) AS files FROM a GROUP BY dir""")  # fmt: skip
def tree(spark, sf):
    p = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")
    return R.tree_rollup(table(spark, sf, "pages").select(p.alias("path"), F.length("html").alias("chars")), ["chars"])


@query("f39_line_of_offset", "SELECT doc_id, CAST(length(substr(text, 1, 100)) - length(replace(substr(text, 1, 100), chr(10), '')) + 1 AS INTEGER) AS line FROM documents")
def line_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.line_of_offset(F.col("text"), F.lit(100)).alias("line"))


@query("a20_reading_minutes", "SELECT doc_id, greatest(1.0, floor(2 * (len(string_split(text, chr(10))) / 25) + 0.5) / 2) AS minutes FROM documents")
def reading(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.reading_minutes(F.size(F.split("text", "\n"))).alias("minutes"))


@query("f19_cell_escape", "SELECT doc_id, md5(replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(9), concat(chr(92), 't')), chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r'))) AS digest FROM documents")
def escaped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.escape_cell(F.col("text"))).alias("digest"))


@query("f19_escape_round_trip", "SELECT count(*) AS n FROM documents")
def round_trip(spark, sf):
    return table(spark, sf, "documents").where(S.unescape_cell(S.escape_cell(F.col("text"))) == F.col("text")).agg(F.count("*").alias("n"))


@query("f20_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("f21_risk_fingerprint", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN concat(l_shipdate_s, chr(1), l_linestatus) ELSE concat(l_shipdate_s, chr(1), l_linestatus, chr(1), l_returnflag) END AS key FROM (SELECT *, CAST(l_partkey AS STRING) AS l_shipdate_s FROM lineitem)")
def fingerprint(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.risk_fingerprint(F.col("l_partkey").cast("string"), F.col("l_linestatus"), F.col("l_returnflag"), F.col("l_returnflag") == "A").alias("key"))


#: paths of all the kinds that the two forms tell apart
PATHS = """SELECT p_partkey AS k, p_partkey % 12 AS m, concat(CASE p_partkey % 12 WHEN 0 THEN 'src/Tests/' WHEN 1 THEN 'e2e/' WHEN 2 THEN 'pkg/__mocks__/' WHEN 3 THEN 'examples/' ELSE 'src/' END, CASE p_partkey % 12 WHEN 4 THEN 'test_' ELSE '' END, 'n', CAST(p_partkey AS STRING),
  CASE p_partkey % 12 WHEN 5 THEN '_test.go' WHEN 6 THEN '.test.local' WHEN 7 THEN '.spec.tsx' WHEN 8 THEN '_spec.rb' WHEN 4 THEN '.py' WHEN 9 THEN 'test.ts' ELSE '.ts' END) AS path FROM part"""


@query("p5_test_paths", "SELECT p_partkey AS k, p_partkey % 12 IN (0, 1, 2, 4, 5, 6, 7, 8) AS loose, p_partkey % 12 IN (0, 2, 4, 5, 7, 8) AS strict, p_partkey % 12 IN (0, 1, 2, 3, 4, 5, 6, 7, 8) AS examples FROM part")
def test_paths(spark, sf):
    p = F.col("path")
    return view(spark, sf, PATHS).select("k", S.is_test_path(p).alias("loose"), S.is_test_path(p, strict=True).alias("strict"), S.is_test_or_example_path(p).alias("examples"))


@query("r2_grep_baseline", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'idiot')")
def grep(spark, sf):
    from stratalens.operators.retrieve import grep

    return grep(table(spark, sf, "documents"), ["license", "idiot"]).select("doc_id")


@query("v19_all_terms_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'id') AND contains(lower(p_name), 'l')")
def terms(spark, sf):
    from stratalens.operators.retrieve import search_all

    return search_all(table(spark, sf, "part"), "p_name", ["ID", "l"]).select("p_partkey", "p_name")


CACHE_KEY = "concat('v4:', coalesce(lang, ''), ':', CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '0' END, ':', sha256(text))"


@query("r9_extraction_cache", f"SELECT {CACHE_KEY} AS key, count(*) AS n FROM documents WHERE {CACHE_KEY} NOT IN (SELECT {CACHE_KEY} FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def cache_misses(spark, sf):
    """Contents that a cache of a third of the documents does not hold yet."""
    key = S.extraction_key("v4", F.coalesce("lang", F.lit("")), F.col("doc_id") % 2 == 0, F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", key.alias("key"))
    cached = d.where("doc_id % 3 = 0").select("key").distinct()
    return d.select("key").join(cached, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


@query("f22_plain_words", """SELECT c_custkey, concat('See docs', CAST(c_nationkey AS STRING), ' for bold, it and code of x.') AS plain, concat('See docs', CAST(c_nationkey AS STRING), ' for bold, it and code of x.') AS first, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a and b' ELSE 'a, b, and c' END AS listed,
  CASE c_custkey % 6 WHEN 0 THEN 'an' WHEN 1 THEN 'a' WHEN 2 THEN 'an' WHEN 3 THEN 'a' WHEN 4 THEN 'an' ELSE 'a' END AS article FROM customer""")  # fmt: skip
def plain_words(spark, sf):
    t = view(spark, sf, "SELECT c_custkey, concat('See [docs', CAST(c_nationkey AS STRING), '](a.md) for  **bold**, *it* and `code` of <b>x</b>.') AS text, slice(array('a', 'b', 'c'), 1, CAST(c_custkey % 3 AS INT) + 1) AS items, CASE c_custkey % 6 WHEN 0 THEN 'MCP server' WHEN 1 THEN 'UI' WHEN 2 THEN 'Express app' WHEN 3 THEN 'user' WHEN 4 THEN 'hour' ELSE 'pnpm repo' END AS phrase FROM customer")
    plain = S.strip_inline_marks(F.col("text"))
    return t.select("c_custkey", plain.alias("plain"), S.first_sentence(F.concat(plain, F.lit(" And more."))).alias("first"), S.join_list(F.col("items")).alias("listed"), S.article(F.col("phrase")).alias("article"))
