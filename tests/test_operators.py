import pytest
from pyspark.sql import functions as F

from stratalens.operators import diff as D
from stratalens.operators import graph as G
from stratalens.operators import log as L
from stratalens.operators import resolve as V
from stratalens.operators import retrieve as T
from stratalens.plans import ask


def graph(spark, edges, kind="import"):
    rows = [(a, b, kind, None) for a, b in edges]
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(i, i + ".ts", i, "file") for i in ids], "id string, path string, name string, kind string")
    return nodes, spark.createDataFrame(rows, "src string, dst string, kind string, confidence string")


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def seed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_verbs_on_a_chain(spark):
    nodes, edges = graph(spark, [("b", "a"), ("c", "b")])
    assert ids(G.impact(edges, seed(spark, "a"), 1), "id") == ["b"] and ids(G.impact(edges, seed(spark, "a")), "id") == ["b", "c"]
    assert [r.id for r in G.path_between(edges, seed(spark, "c"), seed(spark, "a")).orderBy("place").collect()] == ["c", "b", "a"]
    assert G.path_between(edges, seed(spark, "a"), seed(spark, "c")).count() == 0
    assert ids(G.callers(edges, "a"), "id") == ids(G.neighbors(edges, seed(spark, "a"), "in"), "id") == ["b"]
    assert ids(G.imports(edges, seed(spark, "c"), 5), "id") == ["a", "b"]


def test_path_ties_follow_queue_order(spark):
    _, edges = graph(spark, [("s", "b"), ("s", "a"), ("a", "z"), ("b", "y"), ("z", "t"), ("y", "t")])
    assert [r.id for r in G.path_between(edges, seed(spark, "s"), seed(spark, "t")).orderBy("place").collect()] == ["s", "a", "z", "t"]


@pytest.mark.parametrize(
    "edges,extra,want",
    [
        ([("a", "b"), ("a", "c"), ("b", "c")], [], {"a": 0.3793, "b": 0.5405, "c": 1.0}), ([("a", "b")], [], {"a": 0.5405, "b": 1.0}), ([("a", "b"), ("b", "c"), ("c", "a")], [], {"a": 1.0, "b": 1.0, "c": 1.0}),
        ([("auth", "user"), ("auth", "db"), ("user", "db"), ("util", "auth")], ["unrelated"], {"auth": 0.5598, "db": 1.0, "user": 0.5405, "util": 0.3026, "unrelated": 0.3026}),
    ],
)
def test_pagerank(spark, edges, extra, want):
    nodes, e = graph(spark, edges)
    nodes = nodes.select("id").union(seed(spark, *extra)) if extra else nodes
    assert {r.id: r.importance for r in G.pagerank(nodes, e).collect()} == want


def test_components_and_layers(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("p", "q"), ("q", "r"), ("p", "r")]
    nodes, e = graph(spark, edges)
    assert ids(G.strongly_connected(e), "scc", "id") == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e")]
    loop = e.unionAll(spark.createDataFrame([("r", "r", "import", None)], e.schema))
    assert ("r", "r") in ids(G.strongly_connected(loop, self_loops=True), "scc", "id")
    assert ids(G.layers(e, nodes), "id", "layer") == [("p", 0), ("q", 1), ("r", 2), ("x", 0)]
    two, e2 = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d")])
    assert ids(G.label_propagation(two, e2), "id", "community") == [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1), ("f", 1)]


def test_questions(spark):
    nodes, edges = graph(spark, [("b", "a"), ("c", "b")])
    assert ask.plan("is there a path from c to a?") == ask.Plan("path", ("c", "a")) and ask.plan("hello") is None
    assert [r.id for r in ask.run(ask.plan("path from c to a"), nodes, edges).orderBy("place").collect()] == ["c", "b", "a"]
    assert ids(ask.run(ask.plan("what is the impact of a"), nodes, edges), "id") == ["b", "c"]
    assert ids(ask.run(ask.plan("who imports b?"), nodes, edges), "id") == ["c"]


def test_keyed_diff_law(spark):
    prev = spark.createDataFrame([("a", "10"), ("b", "20"), ("c", "30")], "path string, loc string")
    nxt = spark.createDataFrame([("a", "10"), ("b", "99"), ("d", "40")], "path string, loc string")
    added, deleted = D.keyed_diff(prev, nxt, "path")
    assert ids(added, "path") == ["b", "d"] and ids(deleted, "path") == ["b", "c"]
    assert ids(D.apply_diff(prev, added, deleted, "path"), "path", "loc") == ids(nxt, "path", "loc")
    for bad in ([("a", "1"), ("a", "2")], [(None, "1")]):
        with pytest.raises(Exception, match="key"):
            D.keyed_diff(prev, spark.createDataFrame(bad, prev.schema), "path")[0].collect()


def test_multiset_diff(spark):
    def risks(*rows):
        return spark.createDataFrame([(k, f, i) for i, (k, f) in enumerate(rows)], "rule string, file string, line int")

    left = D.multiset_diff(risks(*[("k", "f")] * 3), risks(("k", "f")), ["rule", "file"], ["line"])
    assert [r.side for r in left.collect()] == ["fixed", "fixed"]
    moved = D.multiset_diff(risks(("k", "f")), risks(("k", "g")), ["rule", "file"], ["line"])
    assert D.moved_pairs(moved, ["rule"], ["file"]).count() == 0
    copied = D.multiset_diff(risks(("k", "f")), risks(("k", "f"), ("k", "g")), ["rule", "file"], ["line"])
    assert [(r.side, r.file) for r in D.moved_pairs(copied, ["rule"], ["file"]).collect()] == [("new", "g")]


def test_cycle_delta(spark):
    base = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")], "scc string, id string")
    head = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("c", "e"), ("x", "x"), ("x", "y")], "scc string, id string")
    assert ids(D.cycle_delta(base, head), "scc", "state") == [("a", "old"), ("c", "grown"), ("x", "fresh")]


def test_latest_wins_and_ties(spark):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00", "task", "k", "first"), (2, "2024-01-01 00:00:00", "task", "k", "second"), (3, "2023-01-01 00:00:00", "task", "k", "old"), (4, "2024-02-01 00:00:00", "close", "k", "x"), (5, "2024-01-05 00:00:00", "task", "m", "open")], "line long, ts string, action string, ckey string, text string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert ids(L.latest_by_key(log), "action", "ckey", "text") == [("close", "k", "x"), ("task", "k", "first"), ("task", "m", "open")]
    assert ids(L.open_items(log, "task", "close"), "ckey") == ["m"]


def test_context_budget(spark):
    nodes, edges = graph(spark, [("auth", "user"), ("auth", "db"), ("user", "db"), ("util", "auth")])
    facts = spark.createDataFrame([("auth", 1.0, 300), ("user", 0.5, 200), ("db", 0.8, 400), ("util", 0.2, 100), ("unrelated", 0.1, 5000)], "id string, importance double, tokens long").withColumn("recency", F.lit(0.0))
    got = set(ids(T.assemble(facts, edges, "user", 500), "id"))
    assert {"user", "auth"} <= got and "db" not in got
    assert ids(T.assemble(facts, edges, "user", 50), "id") == ["user"]
    assert ids(T.assemble(facts, edges, "nothing here", 50), "id") == sorted(ids(facts, "id"))


def test_innermost_span_and_imports(spark):
    spans = spark.createDataFrame([("f", 1, 1000, "outer"), ("f", 10, 20, "inner"), ("f", 15, 25, "late")], "file string, start int, end int, id string")
    refs = spark.createDataFrame([("f", 12), ("f", 17), ("f", 900), ("f", 2000), ("g", 5)], "file string, line int")
    got = {(r.file, r.line): r.owner for r in V.innermost(refs, spans, "line", outer=True).collect()}
    assert got == {("f", 12): "inner", ("f", 17): "late", ("f", 900): "outer", ("f", 2000): None, ("g", 5): None}
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("src/b.tsx",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "./lib"), ("src/lib/index.ts", "../a.js"), ("src/a.ts", "../../x"), ("src/a.ts", "react")], "file string, specifier string")
    assert ids(V.resolve_imports(imports, files), "specifier", "target") == [("../a.js", "src/a.ts"), ("./b", "src/b.tsx"), ("./lib", "src/lib/index.ts")]
