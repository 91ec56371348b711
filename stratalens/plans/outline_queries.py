"""Declarations of sources whose parts come and go with the key; the SQL counts their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import outline as O
from stratalens.joins import dealt
from stratalens.plans.adapters import view
from stratalens.registry import query

#: lines with the condition under which a text has them; N is the nation's number
GO_LINES = (
    ("true", "package main // func No() {"), ("c_custkey % 2 = 0", "type TN struct {"), ("c_custkey % 2 = 0", "    A int /* }"), ("c_custkey % 2 = 0", "    } */"), ("c_custkey % 2 = 0", "}"),
    ("true", "func RunN("), ("true", "    x int, m map[string]int) {"), ("c_custkey % 5 = 0", "    if x > N {"), ("true", '    fmt.Println("{%d\\\\" {", ^{^, `'), ("c_custkey % 4 = 1", "func raw() {"), ("true", "  `)"), ("c_custkey % 5 = 0", "    }"), ("true", "}"),
    ("c_custkey % 3 = 0", "const ("), ("c_custkey % 3 = 0", "    aN = 1"), ("c_custkey % 3 = 0", "    _ = f("), ("c_custkey % 3 = 0", "        skipped,"), ("c_custkey % 3 = 0", "    )"), ("c_custkey % 6 = 3", "    B = map[int]int{"), ("c_custkey % 6 = 3", "        1: 2,"), ("c_custkey % 6 = 3", "    }"), ("c_custkey % 3 = 0", ")"),
    ("true", "var zN, w = 1, 2"), ("c_custkey % 7 = 0", "func (t *TN) close() {"), ("c_custkey % 7 = 0", "    defer func() { t.A = 0 }()"), ("c_custkey % 7 = 0", "}"), ("c_custkey % 8 = 0", "type ("), ("c_custkey % 8 = 0", "    I interface {"), ("c_custkey % 8 = 0", "        M()"), ("c_custkey % 8 = 0", "    }"), ("c_custkey % 8 = 0", "    idN []int"), ("c_custkey % 8 = 0", ")"),
    ("c_custkey % 9 = 4", "func open() {"), ("c_custkey % 9 = 4", "    // never closed"),
)
PYTHON_LINES = (
    ("true", "import os"), ("c_custkey % 3 = 0", "MAX_N: int = 3"), ("c_custkey % 2 = 0", "class CN(Base):"), ("c_custkey % 2 = 0", "    limit = 1"), ("c_custkey % 2 = 0", "    def a(self,"), ("c_custkey % 2 = 0", "          b=(1, (2)), *,"), ("c_custkey % 2 = 0", ""), ("c_custkey % 2 = 0", "          c: int = N) -> None:"), ("c_custkey % 4 = 0", "        def inner(): return b"), ("c_custkey % 4 = 0", "        class Deep:"), ("c_custkey % 4 = 0", "            def deepest(self): ..."),
    ("c_custkey % 2 = 0", "        return b"), ("c_custkey % 6 = 0", "    async  def z(self): ..."), ("true", "if os:"), ("true", "    def topN(x): pass"), ("c_custkey % 5 = 0", "\\tdef tabbed(y): pass"), ("true", "lower = 1"), ("c_custkey % 7 = 0", "def broken(x"), ("c_custkey % 7 = 0", "    class After: pass"),
)


def source_texts(spark, sf, lines):
    """path, text: the lines whose condition holds, ^ standing for a quote."""
    parts = ", ".join(f"CASE WHEN {when} THEN replace(replace('{line}', '^', chr(39)), 'N', CAST(c_nationkey AS STRING)) END" for when, line in lines)
    keys = dealt(view(spark, sf, "SELECT c_custkey, c_nationkey FROM customer"))
    return keys.selectExpr("concat('f', CAST(c_custkey AS STRING)) AS path", f"concat_ws(chr(10), {parts}) AS text")


def placed(lines) -> str:
    """The line number of every part of a text, as columns l0, l1, ... of `placed`."""
    sums = ", ".join(" + ".join(f"CAST({when} AS INT)" for when, _ in lines[: k + 1]) + f" AS l{k}" for k in range(len(lines)))
    return f"placed AS (SELECT concat('f', c_custkey) AS path, c_custkey, c_nationkey AS n, {sums}, {' + '.join(f'CAST({when} AS INT)' for when, _ in lines)} AS total FROM customer)"


GO = "('true', concat('Run', n), 'function', l5, l12), ('c2', concat('T', n), 'class', l1, l4), ('c3', concat('a', n), 'constant', l14, l14), ('c63', 'B', 'constant', l18, l20), ('true', concat('z', n), 'variable', l22, l22), ('c7', 'close', 'method', l23, l25), ('c8', 'I', 'interface', l27, l29), ('c8', concat('id', n), 'type', l30, l30), ('c94', 'open', 'function', l32, total)"
WHEN = "CASE c WHEN 'true' THEN true WHEN 'c2' THEN c_custkey % 2 = 0 WHEN 'c3' THEN c_custkey % 3 = 0 WHEN 'c4' THEN c_custkey % 4 = 0 WHEN 'c5' THEN c_custkey % 5 = 0 WHEN 'c6' THEN c_custkey % 6 = 0 WHEN 'c7' THEN c_custkey % 7 = 0 WHEN 'c8' THEN c_custkey % 8 = 0 WHEN 'c63' THEN c_custkey % 6 = 3 WHEN 'c94' THEN c_custkey % 9 = 4 END"


@query("f30_go_symbols", f"""WITH {placed(GO_LINES)} SELECT path, name, kind, start, "end", name[1:1] BETWEEN 'A' AND 'Z' AS exported FROM placed, LATERAL (VALUES {GO}) t(c, name, kind, start, "end") WHERE {WHEN}""")
def go_symbols(spark, sf):
    return O.go_symbols(source_texts(spark, sf, GO_LINES))


# a def that is never closed declares nothing and ends what is open, so the class behind it stands alone
PYTHON = "('c3', l1, concat('MAX_', n), 'variable', concat('MAX_', n), NULL), ('c2', l2, concat('C', n), 'class', concat('class C', n, '(Base)'), NULL), ('c2', l4, 'a', 'method', concat('def a(self, b=(1, (2)), *, c: int = ', n, ')'), l2), ('c4', l8, 'inner', 'method', 'def inner()', l4), ('c4', l9, 'Deep', 'class', 'class Deep', l4), ('c4', l10, 'deepest', 'method', 'def deepest(self)', l9), ('c6', l12, 'z', 'method', 'async def z(self)', l2), ('true', l14, concat('top', n), 'function', concat('def top', n, '(x)'), NULL), ('c5', l15, 'tabbed', 'function', 'def tabbed(y)', NULL), ('c7', l18, 'After', 'class', 'class After', NULL)"


@query("f30_python_outline", f"""WITH {placed(PYTHON_LINES)} SELECT path, line, name, kind, signature, parent FROM placed, LATERAL (VALUES {PYTHON}) t(c, line, name, kind, signature, parent) WHERE {WHEN}""")
def python_outline(spark, sf):
    return O.python_outline(source_texts(spark, sf, PYTHON_LINES))


@query("f30_outline_counts", f"""
  WITH {placed(PYTHON_LINES)}, d AS (SELECT path, kind, parent FROM placed, LATERAL (VALUES {PYTHON}) t(c, line, name, kind, signature, parent) WHERE {WHEN})
  SELECT path, kind, count(*) AS declared, count(parent) AS nested FROM d GROUP BY path, kind""")  # fmt: skip
def outline_counts(spark, sf):
    return O.python_outline(source_texts(spark, sf, PYTHON_LINES)).groupBy("path", "kind").agg(F.count("*").alias("declared"), F.count("parent").alias("nested"))
