"""Structure of source and markup texts by built-in regular expressions.

These cover what patterns can tell; nested grammars (complete parsers of languages and
style sheets) are left out on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lines_of(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, line (1-based), l."""
    return texts.select(key, F.posexplode(F.split("text", "\r?\n")).alias("i", "l")).select(key, (F.col("i") + 1).alias("line"), "l")


def outside_fences(lines: DataFrame, key: str = "path") -> DataFrame:
    """Markdown lines with `fenced`: true inside a code fence and on its marks.

    Fences open and close in turn, so the number of marks before a line tells its state.
    """
    mark = F.col("l").rlike(r"^\s{0,3}(```|~~~)")
    before = F.sum(mark.cast("int")).over(W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("fenced", mark | (F.coalesce(before, F.lit(0)) % 2 == 1))


def markdown_structure(texts: DataFrame) -> DataFrame:
    """path, headings, links, open and done items, tables' separator rows, words outside headings and fences, title."""
    rows = outside_fences(lines_of(texts)).where("not fenced")
    level = F.length(F.regexp_extract("l", r"^(#{1,6})\s", 1))
    title = F.min(F.when(level > 0, F.struct((level != 1).alias("late"), "line", F.trim(F.regexp_replace("l", r"^#+\s+|\s+#+\s*$", "")).alias("t"))))
    return rows.groupBy("path").agg(
        F.count_if(level > 0).alias("headings"), F.sum(F.size(F.regexp_extract_all("l", F.lit(r"(?<!!)\[[^\]]*\]\([^)\s]+[^)]*\)"), 0))).alias("links"), F.count_if(F.col("l").rlike(r"^\s*[-*+]\s+\[ \]")).alias("open_items"), F.count_if(F.col("l").rlike(r"^\s*[-*+]\s+\[[xX]\]")).alias("done_items"),
        F.count_if(F.col("l").rlike(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")).alias("tables"), F.sum(F.when(level > 0, 0).otherwise(F.size(F.regexp_extract_all("l", F.lit(r"\S+"), 0)))).alias("words"), title["t"].alias("title"),
    )


def python_imports(texts: DataFrame) -> DataFrame:
    """path, specifier, names (sorted, '*' for a bare import) of Python texts."""
    rows = lines_of(texts)
    plain = rows.where(F.col("l").rlike(r"^\s*import\s")).select("path", F.explode(F.split(F.regexp_extract("l", r"^\s*import\s+([^#]+)", 1), ",")).alias("s")).select("path", F.regexp_extract(F.trim("s"), r"^([\w.]+)", 1).alias("specifier"), F.lit("*").alias("name"))
    dotted = F.regexp_extract("l", r"^\s*from\s+(\.*[\w.]*)\s+import\s+\(?([^#)]+)", 1)
    names = F.split(F.regexp_extract("l", r"^\s*from\s+(\.*[\w.]*)\s+import\s+\(?([^#)]+)", 2), ",")
    members = rows.where(F.col("l").rlike(r"^\s*from\s+\S+\s+import\s")).select("path", dotted.alias("specifier"), F.explode(names).alias("n")).select("path", "specifier", F.regexp_extract(F.trim("n"), r"^(\w+|\*)", 1).alias("name"))
    both = plain.unionAll(members).where("specifier <> '' and name <> ''")
    return both.groupBy("path", "specifier").agg(F.sort_array(F.collect_set("name")).alias("names"))


def go_imports(texts: DataFrame) -> DataFrame:
    """path, specifier of Go texts: single imports and those in a block."""
    block = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"(?s)\bimport\s*\(([^)]*)\)"), 1), lambda b: F.regexp_extract_all(b, F.lit(r"\"([^\"]+)\""), 1)))
    single = F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\""), 1)
    return texts.select("path", F.explode(F.array_distinct(F.concat(block, single))).alias("specifier"))


def script_imports(texts: DataFrame) -> DataFrame:
    """path, specifier, kind of JavaScript and TypeScript texts, literal specifiers only."""
    rules = (("type-import", r"\b(?:import|export)\s+type\b[^'\"\n;]*?from\s*['\"]([^'\"]+)['\"]"), ("import", r"\b(?:import|export)\b(?!\s+type\b)(?:[^'\"\n;()]*?from)?\s*['\"]([^'\"]+)['\"]"), ("import", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"), ("dynamic-import", r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)"))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda s: F.struct(s.alias("specifier"), F.lit(kind).alias("kind")))

    return texts.select("path", F.explode(F.array_distinct(F.flatten(F.array(*[of(k, p) for k, p in rules])))).alias("i")).select("path", "i.specifier", "i.kind")


def env_reads(texts: DataFrame) -> DataFrame:
    """path, line, name, access, default of environment reads in Python and script texts."""
    rows = lines_of(texts)
    rules = (("required", r"os\.environ\[\s*['\"](\w+)['\"]\s*\]", None), ("optional", r"os\.(?:getenv|environ\.get)\(\s*['\"](\w+)['\"]", r"os\.(?:getenv|environ\.get)\(\s*['\"]\w+['\"]\s*,\s*['\"]([^'\"]*)['\"]"), ("optional", r"process\.env\.(\w+)", None), ("optional", r"import\.meta\.env\.(\w+)", None))
    out = None
    for access, pattern, default in rules:
        value = F.nullif(F.regexp_extract("l", default, 1), F.lit("")) if default else F.lit(None).cast("string")
        one = rows.select("path", "line", F.explode(F.regexp_extract_all("l", F.lit(pattern), 1)).alias("name"), F.lit(access).alias("access"), value.alias("default"))
        out = one if out is None else out.unionAll(one)
    return out.dropDuplicates(["path", "name", "access", "line"])


def routes(texts: DataFrame) -> DataFrame:
    """path, framework, method, route, line of Express-, FastAPI- and Flask-style handlers."""
    rows = lines_of(texts)
    express = rows.select("path", "line", F.lit("express").alias("framework"), F.upper(F.regexp_extract("l", r"\b(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)", 1)).alias("method"), F.regexp_extract("l", r"\b(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)", 2).alias("route")).where("route <> '' and path rlike '[.](js|ts|mjs|cjs)$'")
    fast = rows.select("path", "line", F.lit("fastapi").alias("framework"), F.upper(F.regexp_extract("l", r"^\s*@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)", 1)).alias("method"), F.regexp_extract("l", r"^\s*@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)", 2).alias("route")).where("route <> '' and path like '%.py'")
    methods = F.regexp_extract_all(F.regexp_extract("l", r"methods\s*=\s*\[([^\]]*)\]", 1), F.lit(r"['\"](\w+)['\"]"), 1)
    flask = rows.where("path like '%.py'").select("path", "line", F.lit("flask").alias("framework"), F.explode(F.when(F.size(methods) == 0, F.array(F.lit("GET"))).otherwise(methods)).alias("method"), F.regexp_extract("l", r"^\s*@\w+\.route\(\s*['\"]([^'\"]+)", 1).alias("route")).where("route <> ''")
    return express.unionAll(fast).unionAll(flask)


def ddl_tables(texts: DataFrame) -> DataFrame:
    """path, name, columns, references of CREATE TABLE statements; comments and string literals are blanked first."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)--[^\n]*|/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")
    found = texts.select("path", F.explode(F.regexp_extract_all(bare, F.lit(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?[\w.]+[\"`\]]?\s*\((?:[^()]|\([^()]*\))*\)"), 0)).alias("s"))
    body = F.regexp_extract("s", r"(?s)\((.*)\)\s*$", 1)
    columns = F.filter(F.transform(F.split(body, r",(?![^(]*\))"), lambda c: F.lower(F.regexp_extract(F.trim(c), r"^[\"`\[]?(\w+)", 1))), lambda c: ~c.isin("", "primary", "foreign", "unique", "check", "constraint", "key", "index"))
    return found.select("path", F.regexp_extract("s", r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)", 1).alias("name"), columns.alias("columns"), F.array_distinct(F.regexp_extract_all("s", F.lit(r"(?is)references\s+[\"`\[]?([\w.]+)"), 1)).alias("references"))


def ddl_views(texts: DataFrame) -> DataFrame:
    """path, name, references (tables after FROM and JOIN) of CREATE VIEW statements; comments and string literals are blanked first."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)--[^\n]*|/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")
    found = texts.select("path", F.explode(F.regexp_extract_all(bare, F.lit(r"(?is)create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+[^;]*"), 0)).alias("s"))
    named = F.array_distinct(F.regexp_extract_all("s", F.lit(r"(?is)\b(?:from|join)\s+[\"`\[]?([\w.]+)"), 1))
    return found.select("path", F.regexp_extract("s", r"(?is)view\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)", 1).alias("name"), named.alias("references"))


def hcl_resources(texts: DataFrame) -> DataFrame:
    """path, id, references of Terraform resource blocks; a reference counts if the same file declares it and it is another resource."""
    block = texts.select("path", F.explode(F.split(F.regexp_replace("text", r"(?m)(#|//)[^\n]*$", ""), r"(?m)^(?=resource\s+\"|data\s+\"|variable\s+\"|output\s+\"|module\s+\"|provider\s+\"|locals\s*\{)")).alias("b"))
    r = block.select("path", F.concat_ws(".", F.regexp_extract("b", r"^resource\s+\"([^\"]+)\"\s+\"([^\"]+)\"", 1), F.regexp_extract("b", r"^resource\s+\"([^\"]+)\"\s+\"([^\"]+)\"", 2)).alias("id"), "b").where("id <> '.'")
    refs = r.select("path", "id", F.explode_outer(F.array_distinct(F.regexp_extract_all("b", F.lit(r"\b([a-z]\w*\.[a-zA-Z_][\w-]*)\b"), 1))).alias("ref"))
    known = r.select("path", F.col("id").alias("ref"))
    kept = refs.join(known, ["path", "ref"], "left_semi").where("ref <> id").groupBy("path", "id").agg(F.sort_array(F.collect_set("ref")).alias("references"))
    return r.select("path", "id").distinct().join(kept, ["path", "id"], "left")


def css_rules(texts: DataFrame) -> DataFrame:
    """path, selector, body, important, specificity (a, b, c) of the plain rules of style sheets; at-rule heads are left out."""
    bare = F.regexp_replace("text", r"(?s)/\*.*?\*/", " ")
    found = texts.select("path", F.explode(F.regexp_extract_all(bare, F.lit(r"([^{}@;]+)\{([^{}]*)\}"), 0)).alias("r"))
    one = found.select("path", F.explode(F.split(F.regexp_extract("r", r"^\s*([^{]*?)\s*\{", 1), r"\s*,\s*")).alias("selector"), F.regexp_replace(F.regexp_extract("r", r"\{([^}]*)\}", 1), r"\s+", " ").alias("body"))
    count = {n: F.size(F.regexp_extract_all("selector", F.lit(p), 0)) for n, p in (("a", r"#[\w-]+"), ("b", r"\.[\w-]+|\[[^\]]*\]|(?<!:):(?!:)[\w-]+"), ("c", r"(?:^|[\s>+~])[a-zA-Z][\w-]*|::[\w-]+"))}
    return one.select("path", "selector", F.trim("body").alias("body"), F.size(F.regexp_extract_all("body", F.lit("!important"), 0)).alias("important"), F.struct(*[c.alias(n) for n, c in count.items()]).alias("specificity"))


def css_conflicts(rules: DataFrame) -> DataFrame:
    """path, selector, state: single-class selectors declared more than once, 'conflict' if bodies differ, else 'duplicate'."""
    g = rules.where(F.col("selector").rlike(r"^\.[\w-]+$")).groupBy("path", "selector").agg(F.count("*").alias("n"), F.countDistinct("body").alias("bodies"))
    return g.where("n > 1").select("path", "selector", F.when(F.col("bodies") > 1, "conflict").otherwise("duplicate").alias("state"))


def frameworks(packages: Column) -> Column:
    """Sorted framework names told by dependency names (an array)."""
    known = (("React", "^react$"), ("Next.js", "^next$"), ("Vue", "^vue$"), ("Svelte", "^svelte$"), ("Angular", "^@angular/core$"), ("Express", "^express$"), ("Django", "(?i)^django$"), ("Flask", "(?i)^flask$"), ("FastAPI", "(?i)^fastapi$"), ("Astro", "^astro$"), ("Remix", "^@remix-run/"))
    label = F.lit(None).cast("string")

    def name(p: Column) -> Column:
        out = label
        for n, pattern in reversed(known):
            out = F.when(p.rlike(pattern), n).otherwise(out)
        return out

    return F.sort_array(F.array_distinct(F.filter(F.transform(packages, name), lambda x: x.isNotNull())))


def component_scripts(texts: DataFrame) -> DataFrame:
    """path, source, line_offset, ending of the script blocks of single-file components; blocks with a src or of another type are left out."""
    block = r"(?is)<script\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</script\s*>"
    cut = texts.withColumn("parts", F.split("text", r"(?i)(?=<script\b)"))
    # text before each block tells its line
    rows = cut.select("path", F.posexplode("parts").alias("i", "part"), "parts").withColumn("before", F.array_join(F.slice("parts", F.lit(1), F.col("i")), ""))
    head, body = F.regexp_extract("part", block, 1), F.regexp_extract("part", block, 2)
    kind = F.trim(F.regexp_extract(head, r"(?i)(?:^|\s)type\s*=\s*[\"']?([^\"'>]*)", 1))
    lang = F.lower(F.regexp_extract(head, r"(?i)\blang\s*=\s*[\"']?(tsx|ts|typescript|jsx)\b", 1))
    script = (kind == "") | kind.rlike(r"(?i)^(module|(text|application)/(x-)?(java|ecma|type)script|text/babel)$")
    offset = F.size(F.split(F.concat("before", F.lit("<script"), head, F.lit(">")), "\n")) - 1
    ending = F.when(lang == "tsx", ".tsx").when(lang == "jsx", ".jsx").when(lang != "", ".ts").otherwise(".js")
    return rows.where(F.col("part").rlike(block) & script & ~head.rlike(r"(?i)(^|\s)src\s*=")).select("path", body.alias("source"), offset.alias("line_offset"), ending.alias("ending"))


def manifest_license(path: Column, text: Column) -> Column:
    """Licence that a package.json (text or object form), pyproject.toml or Cargo.toml declares; null if none."""
    name = F.substring_index(path, "/", -1)
    plain, whole = F.get_json_object(text, "$.license"), F.get_json_object(text, "$.license.type")
    npm = F.coalesce(whole, F.when(~F.startswith(plain, F.lit("{")), plain))
    python = F.nullif(F.regexp_extract(text, r"(?im)^\s*license\s*=\s*(?:\{\s*text\s*=\s*)?['\"]([^'\"]+)['\"]", 1), F.lit(""))
    cargo = F.nullif(F.regexp_extract(text, r"(?im)^\s*license\s*=\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))
    return F.when(name == "package.json", npm).when(name == "pyproject.toml", python).when(name == "Cargo.toml", cargo)


def markdown_headings(texts: DataFrame) -> DataFrame:
    """path, line, depth, text of the headings outside fences."""
    rows = outside_fences(lines_of(texts)).where("not fenced").withColumn("depth", F.length(F.regexp_extract("l", r"^(#{1,6})\s", 1)))
    return rows.where("depth > 0").select("path", "line", "depth", F.trim(F.regexp_replace("l", r"^#+\s+|\s+#+\s*$", "")).alias("text"))


def markdown_links(texts: DataFrame) -> DataFrame:
    """path, line, href of the links outside fences."""
    rows = outside_fences(lines_of(texts)).where("not fenced")
    return rows.select("path", "line", F.explode(F.regexp_extract_all("l", F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1)).alias("href"))


def markdown_diagrams(texts: DataFrame) -> DataFrame:
    """path, line, kind of mermaid fences; the kind is a label for the first word inside."""
    rows = outside_fences(lines_of(texts))
    # the line after an opening mark
    after = F.lead("l").over(W.partitionBy("path").orderBy("line"))
    word = F.lower(F.regexp_extract(after, r"^\s*([A-Za-z-]+)", 1))
    label = F.when(word.startswith("flowchart") | (word == "graph"), "flowchart").when(word.startswith("sequence"), "sequence").when(word.startswith("er"), "entity-relationship").when(word.startswith("class"), "class").when(word.startswith("state"), "state").otherwise(word)
    return rows.withColumn("kind", label).where(F.col("l").rlike(r"^\s{0,3}```\s*mermaid")).select("path", "line", "kind")
