"""Licence names and SPDX expressions as columns.

An expression is evaluated while its tokens are folded with `aggregate`: the state is a stack of
open parentheses, each with the union of the alternatives so far and the product of the current
AND chain.  A set of classes is a number with a bit a class, in rank order, so that
both joins are bit arithmetic: OR is the union; under AND all terms bind and the stricter class of
each choice counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.joins import dealt

# fixed values: identifiers in their usual spelling
SPDX_IDS = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Unlicense", "0BSD", "BlueOak-1.0.0", "BSL-1.0", "Zlib", "Python-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "EUPL-1.2", "Proprietary", "UNLICENSED",
)
# fixed values: identifiers that leave the recipient's own code free
PERMISSIVE = ("MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Unlicense", "0BSD", "BlueOak-1.0.0", "BSL-1.0", "Zlib", "Python-2.0")
# fixed values: other spellings of a whole name
ALIASES = (
    (r"(?i)^(?:the\s+)?mit(?:\s+license)?$", "MIT"),
    (r"(?i)^(?:the\s+)?apache(?:\s+software)?(?:\s+license)?[\s,-]*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?$", "Apache-2.0"),
    (r"(?i)^(?:the\s+)?isc(?:\s+license)?$", "ISC"),
    (r"(?i)^(?:new\s+|revised\s+|modified\s+)?bsd(?:\s+license)?$", "BSD-3-Clause"),
    (r"(?i)^bsd[\s-]*3(?:[\s-]*clause)?(?:\s+license)?$", "BSD-3-Clause"),
    (r"(?i)^(?:simplified\s+|freebsd\s+)?bsd[\s-]*2(?:[\s-]*clause)?(?:\s+license)?$", "BSD-2-Clause"),
    (r"(?i)^(?:the\s+)?unlicense$", "Unlicense"),
    (r"(?i)^cc0(?:[\s-]*1\.0)?$", "CC0-1.0"),
    (r"(?i)^(?:mpl|mozilla\s+public\s+license)[\s,-]*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?$", "MPL-2.0"),
)
# fixed values: spellings of the GNU family and of closed terms
GPL_SPELLING = r"(?i)^(?:gnu\s+)?(a|l)?gpl[\s-]*v?(\d)(?:\.(\d))?(\+|[\s-]*or[\s-]*later|[\s-]*only)?$"
BARE_GPL = r"(?i)^(?:gnu\s+)?(?:a|l)?gpl$"
COPYLEFT_ID = r"^(?:GPL-(?:2\.0|3\.0)|LGPL-(?:2\.0|2\.1|3\.0)|AGPL-3\.0)(?:-only|-or-later)?$"
CLOSED = r"(?i)^(?:unlicensed|proprietary|commercial|private|closed(?:[\s-]*source)?|all\s+rights\s+reserved|licenseref-[\w.-]*(?:proprietary|commercial|closed)[\w.-]*)$|^see\s+licen[cs]e\s+in\b"
HEADER = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-:() \t]+)"
HEADER_LINES = 60
#: from lax to strict; bit k of a set of classes stands for the k-th
CLASSES = ("permissive", "unknown", "proprietary", "copyleft")


def _trimmed(name: Column) -> Column:
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def canonical_id(name: Column) -> Column:
    """Known identifiers in their usual spelling, `GPL-2.0+` as `GPL-2.0-or-later`; others unchanged."""
    usual = F.create_map(*[F.lit(x) for s in SPDX_IDS for x in (s.lower(), s)])
    plus = F.regexp_replace(name, r"(?i)^((?:A|L)?GPL-\d\.\d)\+$", "$1-or-later")
    return F.transform(F.array(plus), lambda p: F.coalesce(usual[F.lower(p)], p))[0]


def licence_name(name: Column) -> Column:
    """Identifier of one licence, from its identifier or another spelling."""
    t = _trimmed(name)
    part = lambda k: F.regexp_extract(t, GPL_SPELLING, k)
    kind = F.when(part(4) == "", "").when(part(4).rlike("(?i)only"), "-only").otherwise("-or-later")
    gnu = canonical_id(F.concat(F.upper(part(1)), F.lit("GPL-"), part(2), F.lit("."), F.when(part(3) == "", "0").otherwise(part(3)), kind))
    out = F.when(t.rlike(GPL_SPELLING), gnu).otherwise(canonical_id(t))
    for pattern, spdx in reversed(ALIASES):
        out = F.when(t.rlike(pattern), spdx).otherwise(out)
    return out


def licence_class_bit(name: Column) -> Column:
    """1, 2, 4 or 8: the class of one licence, see CLASSES."""
    t = _trimmed(name)

    def bit(spdx: Column) -> Column:
        return F.when(spdx.rlike(COPYLEFT_ID) | t.rlike(BARE_GPL), 8).when(spdx.isin(*PERMISSIVE), 1).when(t.rlike(CLOSED), 4).otherwise(2)

    # the name is worked out once, for all that look at it
    return F.transform(F.array(licence_name(name)), bit)[0]


def expression_tokens(text: Column) -> Column:
    """Parentheses, operators in capitals (a slash is an OR) and names."""
    raw = F.filter(F.split(F.regexp_replace(text, r"([()/])", " $1 "), r"\s+"), lambda t: t != "")
    return F.transform(raw, lambda t: F.when(t == "/", "OR").when(t.rlike("(?i)^(?:and|or|with)$"), F.upper(t)).otherwise(t))


# kinds of token, and what may come next: a name is due, a name stood before, a closed parenthesis or an exception did, an exception is due
NAME, OPEN, CLOSE, AND, OR, WITH = range(6)
DUE, NAMED, CLOSED_OFF, EXCEPTION = range(4)


def _both(a: Column, b: Column) -> Column:
    """Classes that bind under AND; 0 is no term yet.  A class stays if the other side has one no stricter."""
    return F.when(a == 0, b).otherwise(a.bitwiseAND(-b.bitwiseAND(-b)).bitwiseOR(b.bitwiseAND(-a.bitwiseAND(-a))))


def _merge(s: Column, x: Column) -> Column:
    """The next state (ors, ands: stacks of sets; last; ok) after token x (k, c)."""
    k, last = x["k"], s["last"]
    may = F.when(last == EXCEPTION, True).when(k.isin(NAME, OPEN), last == DUE).when(k == WITH, last == NAMED).otherwise(last.isin(NAMED, CLOSED_OFF) & ((k != CLOSE) | (F.size(s["ors"]) > 1)))
    ored, anded = F.element_at(s["ors"], -1), F.element_at(s["ands"], -1)

    def put(stack: Column, drop: int, *more: Column) -> Column:
        return F.concat(F.slice(stack, 1, F.size(stack) - drop), F.array(*more))

    def state(ors: Column, ands: Column, last: int) -> Column:
        return F.struct(ors.alias("ors"), ands.alias("ands"), F.lit(last).alias("last"), F.lit(True).alias("ok"))

    closed = _both(F.try_element_at(s["ands"], F.lit(-2)), ored.bitwiseOR(anded))
    return (
        F.when(~(s["ok"] & may), F.struct(s["ors"].alias("ors"), s["ands"].alias("ands"), last.alias("last"), F.lit(False).alias("ok")))
        .when(last == EXCEPTION, state(s["ors"], s["ands"], CLOSED_OFF))
        .when(k == NAME, state(s["ors"], put(s["ands"], 1, _both(anded, x["c"])), NAMED))
        .when(k == OPEN, state(put(s["ors"], 0, F.lit(0)), put(s["ands"], 0, F.lit(0)), DUE))
        .when(k == CLOSE, state(F.slice(s["ors"], 1, F.size(s["ors"]) - 1), put(s["ands"], 2, closed), CLOSED_OFF))
        .when(k == OR, state(put(s["ors"], 1, ored.bitwiseOR(anded)), put(s["ands"], 1, F.lit(0)), DUE))
        .otherwise(state(s["ors"], s["ands"], F.when(k == AND, DUE).otherwise(EXCEPTION)))
    )


def expression_classes(text: Column) -> Column:
    """The set of classes, as bits, that a well-formed expression offers; null if it is not one."""
    kinds = {"(": OPEN, ")": CLOSE, "AND": AND, "OR": OR, "WITH": WITH}

    def typed(t: Column) -> Column:
        kind = F.lit(NAME)
        for sign, k in kinds.items():
            kind = F.when(t == sign, k).otherwise(kind)
        return F.struct(kind.alias("k"), licence_class_bit(t).alias("c"))

    start = F.struct(F.array(F.lit(0)).alias("ors"), F.array(F.lit(0)).alias("ands"), F.lit(DUE).alias("last"), F.lit(True).alias("ok"))
    whole = lambda s: s["ok"] & (F.size(s["ors"]) == 1) & s["last"].isin(NAMED, CLOSED_OFF)
    return F.aggregate(F.transform(expression_tokens(text), typed), start, _merge, lambda s: F.when(whole(s), s["ors"][0].bitwiseOR(s["ands"][0])))


def offer_bits(text: Column) -> Column:
    """Classes a recipient may choose from: those of the whole text as one name, else of the expression, else unknown."""
    whole = licence_class_bit(text)
    return F.when(whole != 2, whole).otherwise(F.coalesce(expression_classes(text), F.lit(2)))


def class_names(bits: Column) -> Column:
    """Names of a set of classes, from lax to strict."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(1 << k) > 0, c) for k, c in enumerate(CLASSES)]), lambda c: c.isNotNull())


def header_expression(text: Column) -> Column:
    """The SPDX expression of a header in the first lines, normalised; of other text behind the tag the first name; null if there is no tag."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, HEADER_LINES), "\n")
    raw = F.regexp_replace(F.regexp_extract(head, HEADER, 1), r"[\s-]+$", "")
    usual = F.transform(expression_tokens(raw), lambda t: F.when(t.isin("(", ")", "AND", "OR", "WITH"), t).otherwise(canonical_id(t)))
    whole = F.regexp_replace(F.regexp_replace(F.array_join(usual, " "), r"\( ", "("), r" \)", ")")
    first = F.filter(F.split(raw, r"[\s()]+"), lambda t: t != "")
    # a slash is no character of a header
    return F.when(raw != "", F.when(expression_classes(raw).isNotNull(), whole).otherwise(canonical_id(F.coalesce(F.get(first, F.lit(0)), raw))))


def licence_risks(files: DataFrame, projects: DataFrame) -> DataFrame:
    """project, path, licence, severity, reason: files that leave no choice but copyleft inside a project that does not offer the same.

    files: project, path, licence; projects: project, licence, has_file (whether a licence
    file exists).  A project without any licence has a row of its own, without a path.
    Files of a project that is not listed have no row.  The join may split hot projects, as its other
    side has one row a project.
    """
    bound = dealt(files).where(F.col("licence").isNotNull() & (offer_bits(F.col("licence")) == 8))
    own = projects.select("project", F.col("licence").alias("whole"), "has_file", F.when(F.col("licence").isNotNull(), offer_bits(F.col("licence"))).alias("offers"))
    has = lambda bit: F.col("offers").bitwiseAND(bit) > 0
    reason = F.when(F.col("offers").isNull(), F.when(F.col("has_file"), "unrecognised-file").otherwise("undeclared")).when(has(1), "permissive-project").when(has(4), "closed-project").when(F.col("offers") != 8, "unknown-project")
    found = bound.join(own, "project").withColumn("reason", reason).where("reason is not null")
    severity = F.when(F.col("reason").isin("permissive-project", "closed-project"), "high").otherwise("medium")
    none = own.where(F.col("whole").isNull() & ~F.coalesce("has_file", F.lit(False)))
    return found.select("project", "path", "licence", severity.alias("severity"), "reason").unionAll(
        none.select("project", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("low"), F.lit("no-licence"))
    )
