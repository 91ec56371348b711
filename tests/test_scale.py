"""Shapes that keep work, memory and the driver's share in proportion as tables grow."""

import re

from pyspark.sql import functions as F

from stratalens import joins, registry
from stratalens.functions import css, outline
from stratalens.operators import diff as D
from stratalens.operators import graph as G
from stratalens.operators import modules as M
from stratalens.operators import rollup as R
from stratalens.sources import locks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(monkeypatch, module):
    """Names and frames of the module's cuts, in order."""
    seen, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, name: seen.append((name, df)) or cut(df, name))
    return seen


def test_go_targets_broadcast_nothing(spark):
    i = spark.createDataFrame([("m/main.go", "x.com/m/a")], "file string, specifier string")
    f = spark.createDataFrame([("m/a/b.go",)], "path string")
    m = spark.createDataFrame([("x.com/m", "m", 0)], "module string, dir string, place int")
    got = M.go_targets(i, f, m)
    assert "Broadcast" not in plan(got) and [r.target for r in got.collect()] == ["m/a/b.go"]


def test_python_targets_broadcast_nothing(spark):
    i = spark.createDataFrame([("p/a.py", ".b"), ("p/a.py", "p.b")], "file string, specifier string")
    f = spark.createDataFrame([("p/a.py",), ("p/b.py",), ("p/__init__.py",)], "path string")
    got = M.python_targets(i, f)
    assert "Broadcast" not in plan(got) and {r.target for r in got.collect()} == {"p/b.py"}


def test_env_rollup_lists_its_defaults(spark):
    rows = [("A", "f", 1, "required", "2"), ("A", "f", 2, "required", "10"), ("A", "g", 1, "required", "2"), ("B", "f", 3, "optional", None)]
    got = R.env_rollup(spark.createDataFrame(rows, "name string, file string, line int, access string, default string")).collect()
    assert {(r.name, r.n, r.defaults, r.n_defaults) for r in got} == {("A", 3, "10,2", 2), ("B", 1, "", 0)}


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_components_move_numbers_and_drop_what_is_in_no_cycle(spark, monkeypatch):
    rows = [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("a", "c0"), ("c2", "z"), ("z", "zz"), ("zz", "zz"), ("p", "q"), ("q", "p")]
    seen = written(monkeypatch, G)
    got = {(r.scc, r.id) for r in G.strongly_connected(edges(spark, rows)).collect()}
    assert got == {("c0", f"c{i}") for i in range(5)} | {("p", "p"), ("p", "q")}
    colours = [df for name, df in seen if name == "scc-colour"]
    assert all(df.schema["c"].dataType.simpleString() == "bigint" for df in colours)
    assert colours[0].select("id").distinct().count() == 7


def test_reach_counts_search_around_the_largest_component(spark, monkeypatch):
    n = 150
    rows = [(f"c{i}", f"c{(i + 1) % n}") for i in range(n)] + [("a", "b"), ("b", "c0"), ("b", "x"), ("c3", "d"), ("d", "e"), ("x", "d"), ("x", "y")]
    seen = written(monkeypatch, G)
    e = edges(spark, rows)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    got = {r.id: r.reached for r in G.reach_counts(e, nodes, "out").collect()}
    assert got == {f"c{i}": n + 1 for i in range(n)} | {"a": n + 5, "b": n + 4, "d": 1, "x": 3}
    assert max(df.count() for name, df in seen if name == "bits-seen") < 20  # not nodes times words


def test_layers_broadcast_nothing(spark, monkeypatch):
    seen = written(monkeypatch, G)
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "k"), ("k", "l"), ("l", "k")])
    got = {(r.id, r.layer) for r in G.layers(e, spark.createDataFrame([(x,) for x in "abckl"], "id string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    assert not any("Broadcast" in plan(df) for _, df in seen)


def test_licence_texts_are_dealt_over_tasks(spark, sf):
    for name in ("f7_licence_offers", "f7_licence_risks"):
        assert "RoundRobinPartitioning" in plan(registry.queries()[name](spark, sf))


def test_python_outline_shuffles_texts_once(spark):
    df = spark.createDataFrame([("a.py", "class A:\n    def f(self, x=(1, (2))): pass\ndef g(")], "path string, text string")
    got = outline.python_outline(df)
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert {(r.line, r.name, r.signature, r.parent) for r in got.collect()} == {(1, "A", "class A", None), (2, "f", "def f(self, x=(1, (2)))", 1)}


def test_lock_lines_shuffle_texts_once(spark):
    got = locks.keyed_lines(spark.createDataFrame([("a", "a:\n  b: 1\n  c:\n    d: 2")], "path string, text string"))
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert {tuple(r["keys"]) for r in got.collect()} == {("a",), ("a", "b"), ("a", "c"), ("a", "c", "d")}


def test_sheets_are_dealt_over_tasks_before_they_are_cut_up(spark):
    got = css.css_blocks(spark.createDataFrame([("a.css", ".a { b: c }")], "path string, text string"))
    assert "REPARTITION_BY_NUM" in plan(got) and got.count() == 1


def test_multisets_are_ranked_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    base = [(f"r{i % 7}", f"f{i % 11}", i) for i in range(150)]
    head = [(f"r{i % 7}", f"f{i % 11}", i * 3 % 100) for i in range(215)] + [("r0", "g", 1), ("r0", "g", 1)]
    got = D.multiset_diff(*(spark.createDataFrame(x, "rule string, file string, line int") for x in (base, head)), ["rule", "file"], ["line"])
    exchanges = re.findall(r"hashpartitioning\(rule#\d+, file#\d+, (\d+)\), REPARTITION_BY_NUM", plan(got))
    assert exchanges == ["15", "22"]  # 150 and 217 rows, not one number for any size
    want = []
    for k in {x[:2] for x in base + head}:
        b, h = (sorted(x[2] for x in side if x[:2] == k) for side in (base, head))
        want += [(*k, n, "fixed") for n in b[len(h) :]] + [(*k, n, "new") for n in h[len(b) :]]
    assert sorted((r.rule, r.file, r.line, r.side) for r in got.collect()) == sorted(want)


def test_multisets_sort_their_rows_once(spark):
    rows = spark.createDataFrame([("r", "f", 1), ("r", "g", 2)], "rule string, file string, line int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = plan(D.multiset_diff(rows, rows.where("line > 1"), ["rule", "file"], ["line"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.count("Sort [") == 4  # on either side one of rows and one of counts


def test_dependents_are_dealt_before_they_are_told_apart(spark, sf):
    assert re.search(r"hashpartitioning\(dst#\d+, src#\d+, 4\), REPARTITION_BY_NUM", plan(registry.queries()["d12_verdict"](spark, sf)))
