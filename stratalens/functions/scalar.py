"""Scalar column functions; all run in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words of a task that name the action, not the code; fixed values
STOP_WORDS = ("add", "new", "fix", "the", "and", "for", "with", "this", "that", "from", "into", "make", "update", "change", "create", "remove", "delete", "support", "using", "feature", "refactor", "implement", "want", "need", "please", "should", "could", "would", "when", "where", "what", "file", "files", "use")
#: extension -> language label; fixed values
LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "go": "Go", "rs": "Rust", "java": "Java", "rb": "Ruby", "php": "PHP", "css": "CSS", "scss": "SCSS", "html": "HTML", "md": "Markdown", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "sql": "SQL", "tf": "Terraform", "sh": "Shell", "vue": "Vue", "svelte": "Svelte", "astro": "Astro"}
CONFIDENCE = {"extracted": 0, "inferred": 1, "ambiguous": 2}
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1, "unknown": 2}


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds half toward plus infinity, also below zero."""
    s = 10**digits
    return F.floor(x * s + 0.5) / s if digits else F.floor(x + 0.5)


def round4(x: Column) -> Column:
    return round_half_up(x, 4)


def token_estimate(text: Column) -> Column:
    """Estimated tokens: 0 for empty text, else length / 3.5 rounded half up, at least 1; null stays null."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 3.5 + 0.5))).cast("long")


def reading_minutes(loc: Column, bonus: Column | None = None) -> Column:
    """Half-minute steps, at least one minute: 25 lines a minute plus a bonus."""
    x = loc / 25 if bonus is None else loc / 25 + bonus
    return F.greatest(F.lit(1.0), F.floor(2 * x + 0.5) / 2)


def glob_matches(s: Column, pattern: str, max_length: int = 256) -> Column:
    """Empty pattern: true; without wildcards: substring; else anchored with * any run and ? one character.

    Compiles to LIKE, which Catalyst turns into prefix, suffix or contains tests where it can.
    """
    if len(pattern) > max_length:
        raise ValueError(f"pattern is longer than {max_length}")
    if not pattern:
        return F.lit(True)
    if not re.search(r"[*?]", pattern):
        return F.contains(s, F.lit(pattern))
    like = re.sub(r"([\\%_])", r"\\\1", pattern)
    return s.like(re.sub(r"\*+", "%", like).replace("?", "_"))


def confidence_rank(c: Column) -> Column:
    """extracted 0, inferred 1, ambiguous 2; null counts as extracted."""
    out = F.lit(0)
    for name, rank in CONFIDENCE.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[extension(path)], F.lit("Other"))


#: folders of tests and fixtures; the broad form has more; fixed values
FIXTURE_DIRS = "test|tests|__tests__|__test__|__mocks__|__fixtures__|fixtures|fixture|testdata|test-data"
MORE_TEST_DIRS = "testing|cypress|e2e|playwright"


def is_test_path(path: Column, strict: bool = False) -> Column:
    """Test and fixture paths by folder or by name; the strict form leaves tool folders out and takes `.test.` and `.spec.` names of source files only."""
    u = canonical_path(path)
    folder = u.rlike(f"(?i)(^|/)({FIXTURE_DIRS}{'' if strict else '|' + MORE_TEST_DIRS})/")
    name = u.rlike(r"(?i)\.(test|spec)\.([cm]?[jt]sx?|py|go|rb)$" if strict else r"(?i)\.(test|spec)\.[a-z0-9]+$")
    return folder | name | u.rlike(r"(?i)(^|/)([^/]+_test\.go|test_[^/]+\.py|[^/]+_test\.py|conftest\.py|[^/]+_(spec|test)\.rb|spec_helper\.rb)$")


def is_test_or_example_path(path: Column) -> Column:
    return is_test_path(path) | canonical_path(path).rlike("(?i)(^|/)examples/")


def is_source_path(path: Column) -> Column:
    return extension(path).isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "rb", "php", "vue", "svelte", "astro")


def is_lock_or_dotfile(path: Column) -> Column:
    name = basename(path)
    return name.isin("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "poetry.lock", "go.sum", "Gemfile.lock") | name.startswith(".")


def doc_kind(path: Column) -> Column:
    name = F.lower(basename(path))
    return (
        F.when(name.startswith("readme"), "readme").when(name.startswith("changelog"), "changelog").when(name.startswith("contributing"), "contributing").when(name.startswith("license"), "license")
        .when(name.contains("roadmap"), "roadmap").when(name.contains("plan"), "plan").when(name.contains("spec"), "spec").when(F.lower(path).rlike(r"(^|/)(adr|decisions)/"), "adr").when(F.lower(path).rlike(r"(^|/)docs?/"), "guide").otherwise("other")
    )


def query_tokens(question: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased runs of letters and digits of at least three characters in order, stop words left out; repeats stay."""
    runs = F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9]+)"), 1)
    return F.filter(runs, lambda w: (F.length(w) >= 3) & ~w.isin(*stop))


def identifier_words(name: Column) -> Column:
    """Words of an identifier: cut at other characters, at lower-to-upper and at letter-to-digit changes."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Za-z])([0-9])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: F.length(w) >= 3)


def word_hit(words: Column, token: Column) -> Column:
    return F.exists(words, lambda w: F.startswith(w, token))


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substr(text, F.lit(1), offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def todo_hits(text: Column, most: int = 50) -> Column:
    """First marker of each line: array of (line, kind, text of at most 200 characters)."""
    lines = F.split(text, "\n")
    found = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, r"\b(TODO|FIXME|HACK|XXX|NOTE)\b", 1).alias("kind"), F.substring(F.trim(F.regexp_extract(x, r"\b(?:TODO|FIXME|HACK|XXX|NOTE)\b[:\s]*(.*)$", 1)), 1, 200).alias("text")))
    return F.slice(F.filter(found, lambda r: r["kind"] != ""), 1, most)


#: ordered, first match wins; patterns on text with white space collapsed and lower-cased; fixed values
LICENSE_PATTERNS = (
    ("AGPL-3.0", r"gnu affero general public license version 3"),
    ("LGPL-3.0", r"gnu lesser general public license version 3"),
    ("LGPL-2.1", r"gnu lesser general public license version 2\.1"),
    ("LGPL-2.0", r"gnu library general public license version 2"),
    ("GPL-3.0", r"gnu general public license version 3"),
    ("GPL-2.0", r"gnu general public license version 2"),
    ("Apache-2.0", r"apache license,? version 2\.0"),
    ("MPL-2.0", r"mozilla public license,? (?:version|v\.) 2\.0"),
    ("MIT", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("ISC", r"with or without fee is hereby granted, provided that"),
    ("0BSD", r"with or without fee is hereby granted\."),
    ("BSD-3-Clause", r"redistribution and use in source and binary forms.*(?:neither the name|endorse or promote)"),
    ("BSD-2-Clause", r"redistribution and use in source and binary forms"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("BSL-1.0", r"boost software license - version 1\.0"),
    ("CC0-1.0", r"cc0 1\.0 universal"),
)
LICENSE_GATE = "|".join(p for _, p in LICENSE_PATTERNS)


def license_of(text: Column) -> Column:
    """SPDX tag first, else the first of the ordered patterns; null if none.

    White space is collapsed once (a lambda binds it), and one alternation turns texts away
    that no pattern can match.
    """

    def first(flat: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(LICENSE_PATTERNS):
            out = F.when(flat.rlike(pattern), name).otherwise(out)
        return F.when(flat.rlike(LICENSE_GATE), out)

    tag = F.regexp_extract(text, r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", 1)
    return F.when(tag != "", tag).otherwise(F.transform(F.array(F.lower(F.regexp_replace(text, r"\s+", " "))), first)[0])


def license_class(spdx: Column) -> Column:
    return (
        F.when(spdx.isNull(), "unknown").when(spdx.rlike("^(AGPL|GPL)"), "strong-copyleft").when(spdx.rlike("^(LGPL|MPL|EPL)"), "weak-copyleft").when(spdx.rlike("^(MIT|Apache|BSD|ISC|Unlicense|0BSD)"), "permissive")
        .when(spdx.rlike("-NC"), "non-commercial").when(spdx == "Proprietary", "proprietary").otherwise("other")
    )


#: rule id -> pattern of a public provider token format
SECRET_RULES = {
    "aws-access-key": r"\bAKIA[0-9A-Z]{16}\b", "github-token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b", "gitlab-token": r"\bglpat-[A-Za-z0-9_-]{20}\b", "npm-token": r"\bnpm_[A-Za-z0-9]{36}\b", "stripe-secret-key": r"\bsk_live_[A-Za-z0-9]{24,}\b",
    "sendgrid-api-key": r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}\b", "slack-webhook": r"https://hooks\.slack\.com/services/[A-Za-z0-9/]+", "private-key-header": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "generic-secret": r"(?i)\b(?:token|secret|api_key|password)\s*[:=]\s*\"[A-Za-z0-9_/+-]{16,}\"",
}


#: what any match of a rule holds; a text without it is not searched for the rule.  The last rule ignores case
SECRET_STEMS = {
    "aws-access-key": ("AKIA",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gitlab-token": ("glpat-",), "npm-token": ("npm_",), "stripe-secret-key": ("sk_live_",),
    "sendgrid-api-key": ("SG.",), "slack-webhook": ("https://hooks.slack.com/services/",), "private-key-header": ("PRIVATE KEY-----",), "generic-secret": ("token", "secret", "api_key", "password"),
}


def secret_hits(text: Column) -> Column:
    """array of (rule, value): every match of every rule, in rule order; plain substrings turn texts away before any pattern runs."""
    none = F.array().cast("array<struct<rule: string, value: string>>")

    def of_rule(rule: str, pattern: str) -> Column:
        where = F.lower(text) if pattern.startswith("(?i)") else text
        held = reduce(lambda a, b: a | b, [where.contains(s) for s in SECRET_STEMS[rule]])
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))
        return F.when(held, found).otherwise(none)

    return F.flatten(F.array(*[of_rule(r, p) for r, p in SECRET_RULES.items()]))


def redact_secrets(text: Column) -> Column:
    """Secret values replaced; line breaks stay."""
    return reduce(lambda t, p: F.regexp_replace(t, p, "[redacted]"), SECRET_RULES.values(), text)


def secret_digest(rule: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(rule, value), 256), 1, 12)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars)
    terms = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def scrub(text: Column) -> Column:
    """E-mail addresses and home folders masked for shared exports."""
    return F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"), r"(/home/|/Users/|C:\\Users\\)[^/\\\s]+", "$1[user]")


def slug(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), F.lit("-"))


def strip_tags(html: Column) -> Column:
    gone = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(gone, r"\s+", " "))


def html_links(html: Column) -> Column:
    """array of the targets of links."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)


def html_structure(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, headings, links, paragraphs, title of pages."""
    n = {k: F.size(F.regexp_extract_all(html, F.lit(p), 0)).cast("long").alias(k) for k, p in (("headings", r"(?i)<h[1-6]\b"), ("links", r"(?i)<a\s[^>]*href="), ("paragraphs", r"(?i)<p\b"))}
    return pages.select(key, *n.values(), F.regexp_extract(html, "(?i)<title>([^<]*)</title>", 1).alias("title"))


def strip_inline_marks(text: Column) -> Column:
    """Markdown text without links, images, tags, emphasis and code marks; white space collapsed."""
    for pattern, to in ((r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\[[^\]]*\]", "$1"), (r"</?[a-zA-Z][^>]*>", ""), (r"\*\*(?=\S)(.+?)\*\*", "$1"), (r"(^|[^\w*])\*(?=\S)([^*\n]+?)\*(?!\w)", "$1$2"), (r"(^|[^\w_])_(?=\S)([^_\n]+?)_(?!\w)", "$1$2"), ("`([^`]+)`", "$1"), (r"\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def join_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b, and c'; empty for none."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(F.lit(0), n - 1)), ", ")
    return F.when(n <= 2, F.array_join(items, " and ")).otherwise(F.concat(head, F.lit(", and "), F.element_at(items, -1)))


#: letters whose names begin with a vowel sound; fixed values
VOWEL_SOUNDS = "AEFHILMNORSX"


def article(phrase: Column) -> Column:
    """'a' or 'an' by the sound of the first word; acronyms are read letter by letter."""
    word = F.regexp_extract(phrase, r"^[A-Za-z0-9.]+", 0)
    acronym = word.rlike("^[A-Z0-9]{2,}$")
    return (
        F.when(word == "", "a").when(word.rlike("^(npm|nx|nvm)$"), "an").when(acronym, F.when(word.rlike(f"^[{VOWEL_SOUNDS}]"), "an").otherwise("a"))
        .when(word.rlike(r"(?i)^(uni|use|usa|euro|one\b|once)"), "a").when(word.rlike("(?i)^(hour|honest|honou?r|heir)"), "an").when(word.rlike("(?i)^[aeiou]"), "an").otherwise("a")
    )


def extraction_key(version: str, ending: Column, refs: Column, text: Column) -> Column:
    """Key of a cached extraction: its version, the file's ending, whether references were wanted, and the content."""
    return F.concat_ws(":", F.lit(version), ending, refs.cast("int").cast("string"), F.sha2(text, 256))


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"^[\s\S]*?(?:[.!?](?=\s|$)|$)", 0))


def escape_cell(s: Column) -> Column:
    """Backslash, tab, newline and carriage return escaped, in this order."""
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unescape_cell(s: Column) -> Column:
    s = F.replace(s, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def risk_fingerprint(rule: Column, file: Column, message: Column, per_file: Column) -> Column:
    """Key under which findings are paired; per-file categories leave the message out."""
    return F.when(per_file, F.concat_ws("\u0001", rule, file)).otherwise(F.concat_ws("\u0001", rule, file, message))


def severity_weight(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv])
    return F.coalesce(table[severity], F.lit(2))


def cvss3_score(vector: Column) -> Column:
    """Base score of a CVSS 3 vector by the public formula; null if a metric is missing."""
    m = F.str_to_map(F.regexp_replace(vector, r"^CVSS:3\.[01]/", ""), F.lit("/"), F.lit(":"))

    def pick(metric: str, values: dict[str, float]) -> Column:
        t = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return t[m[metric]]

    changed = m["S"] == "C"
    pr = F.when(changed, pick("PR", {"N": 0.85, "L": 0.68, "H": 0.5})).otherwise(pick("PR", {"N": 0.85, "L": 0.62, "H": 0.27}))
    cia = {"H": 0.56, "L": 0.22, "N": 0.0}
    iss = 1 - (1 - pick("C", cia)) * (1 - pick("I", cia)) * (1 - pick("A", cia))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    exploit = 8.22 * pick("AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}) * pick("AC", {"L": 0.77, "H": 0.44}) * pr * pick("UI", {"N": 0.85, "R": 0.62})
    raw = F.least(F.lit(10.0), F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit))
    cents = F.floor(raw * 100000 + 0.5).cast("long")
    up = F.when(cents % 10000 == 0, cents / 100000).otherwise((F.floor(cents / 10000) + 1) / 10)
    return F.when(impact.isNull() | exploit.isNull(), None).when(impact <= 0, F.lit(0.0)).otherwise(up)


def cvss2_score(vector: Column) -> Column:
    """Base score of a CVSS 2 vector by the public formula; null if a metric is missing."""
    m = F.str_to_map(vector, F.lit("/"), F.lit(":"))

    def pick(metric: str, values: dict[str, float]) -> Column:
        t = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return t[m[metric]]

    cia = {"N": 0.0, "P": 0.275, "C": 0.660}
    impact = 10.41 * (1 - (1 - pick("C", cia)) * (1 - pick("I", cia)) * (1 - pick("A", cia)))
    exploit = 20 * pick("AV", {"L": 0.395, "A": 0.646, "N": 1.0}) * pick("AC", {"H": 0.35, "M": 0.61, "L": 0.71}) * pick("Au", {"M": 0.45, "S": 0.56, "N": 0.704})
    f = F.when(impact == 0, F.lit(0.0)).otherwise(F.lit(1.176))
    return F.floor((0.6 * impact + 0.4 * exploit - 1.5) * f * 10 + 0.5) / 10


def severity_of_score(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("unknown")


def semver_key(version: Column) -> Column:
    """Sortable key of a semantic version: (major, minor, patch, release, prerelease key); null if it is none."""
    pattern = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z.-]+)?$"
    pre = F.regexp_extract(version, pattern, 4)
    # numeric parts sort before words, and by length first
    parts = F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 18, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return F.when(
        version.rlike(pattern),
        F.struct(*[F.regexp_extract(version, pattern, k).cast("long").alias(n) for k, n in ((1, "major"), (2, "minor"), (3, "patch"))], (pre == "").alias("release"), F.when(pre == "", F.lit("")).otherwise(F.array_join(parts, "\u0001")).alias("pre")),
    )


def is_registry_spec(spec: Column) -> Column:
    """True if a dependency spec names a registry version or range, not a folder, link, archive or repository."""
    s = F.trim(spec)
    return ~(s.rlike(r"(?i)^(workspace|file|link|portal|patch|exec|catalog|git|git\+[a-z]+|github|gitlab|bitbucket|gist|https?):") | s.startswith("git@") | s.contains("/"))


def range_floor(spec: Column) -> Column:
    """Concrete lowest version of an npm range; null if it names none.

    The first comparator of the first `||` set that has a floor counts.  `<X` alone has
    none, `<=X` gives X, `>X` the next version above X; missing and x parts are 0; a
    prerelease tag stays with a full version; aliases (npm:) and specs outside the registry
    give null.
    """
    pattern = r"^(\d+)(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(-[0-9A-Za-z.-]+)?"

    def floor(part: Column) -> Column:
        first = F.trim(part)
        first = F.when(first.startswith("<="), F.substring(first, 3, 1 << 20)).otherwise(first)
        strict = first.startswith(">") & ~first.startswith(">=")
        clean = F.regexp_replace(F.regexp_replace(first, r"^[\s^~>=]+", ""), "(?i)^v", "")
        major, minor, patch, tag = (F.regexp_extract(clean, pattern, k) for k in (1, 2, 3, 4))
        has_minor = minor.rlike(r"^\d+$")
        has_patch = has_minor & patch.rlike(r"^\d+$")

        def up(x: Column) -> Column:
            return (x.cast("long") + 1).cast("string")

        above = F.when(has_patch, F.concat_ws(".", major, minor, F.when(tag != "", patch).otherwise(up(patch)))).when(has_minor, F.concat(major, F.lit("."), up(minor), F.lit(".0"))).otherwise(F.concat(up(major), F.lit(".0.0")))
        zero = F.lit("0")
        own = F.concat(F.concat_ws(".", major, F.when(has_minor, minor).otherwise(zero), F.when(has_patch, patch).otherwise(zero)), F.when(has_patch, tag).otherwise(""))
        return F.when(first.startswith("<") | (major == ""), None).when(strict, above).otherwise(own)

    s = F.trim(spec)
    floors = F.filter(F.transform(F.split(s, r"\|\|"), floor), lambda v: v.isNotNull())
    return F.when((s != "") & ~s.startswith("npm:") & is_registry_spec(s), F.try_element_at(floors, F.lit(1)))


def npm_alias(spec: Column) -> Column:
    """(name, range) of `npm:<name>@<range>`; null if the spec is no alias or only qualifies a range."""
    name, rng = F.regexp_extract(spec, r"^npm:(@?[^@]+)(?:@(.*))?$", 1), F.regexp_extract(spec, r"^npm:(@?[^@]+)(?:@(.*))?$", 2)
    only = ~F.substring(spec, 6, 1 << 20).contains("@") & name.rlike(r"^(?:v?\d+(?:\.[\dxX*]+){0,2}(?:[-+][0-9A-Za-z.-]*)?|[xX*])$")
    return F.when(name.rlike(r"(?i)^(?:@[a-z0-9-~][a-z0-9-._~]*/)?[a-z0-9-~][a-z0-9-._~]*$") & ~only, F.struct(name.alias("name"), rng.alias("range")))


def canonical_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def route_of_path(path: Column) -> Column:
    """Route of a pages- or app-folder file; null for other files."""
    inner = F.regexp_extract(path, r"(?:^|/)(?:pages|app|routes)/(.*)\.(?:tsx?|jsx?|astro|vue|svelte)$", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"(^|/)(index|page|route)$", ""), r"(^|/)\([^)]*\)", ""), "^/", "")
    return F.when(inner == "", None).otherwise(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(bare, r"\[\.\.\.([^\]]+)\]", "*$1"), r"\[([^\]]+)\]", ":$1")))
