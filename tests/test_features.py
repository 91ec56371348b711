"""Licence expressions, flows, commit logs, declarations, sheets, locks, packs, bit-parallel reach and the open items stream, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratalens.functions import css, licences, outline
from stratalens.operators import flow
from stratalens.operators import graph as G
from stratalens.operators.log import open_items
from stratalens.sources import locks, pack, snapshots
from stratalens.sources.commit_log import read_commit_log
from stratalens.streaming import log_stream as LS

RANK = {"permissive": 0, "unknown": 1, "proprietary": 2, "copyleft": 3}
NAMES = {"MIT": 0, "Foo-2": 1, "LicenseRef-private-closed": 2, "GPL-3.0+": 3, "lgplv2.1 ": 3, "ISC": 0}


def random_expression(rng, depth):
    """Text and set of ranks of a random nested expression."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice([n for n in NAMES if " " not in n])
        return name + rng.choice(["", "", " WITH x-exception"]), {NAMES[name]}
    parts = [random_expression(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    if rng.random() < 0.5:
        return "(" + rng.choice([" OR ", " or "]).join(t for t, _ in parts) + ")", set().union(*(r for _, r in parts))
    ranks = {0}
    for _, r in parts:
        ranks = {max(a, b) for a in ranks for b in r}
    return "(" + " AND ".join(t for t, _ in parts) + ")", ranks


def test_expressions_of_any_nesting(spark):
    rng = random.Random(4)
    cases = [random_expression(rng, 4) for _ in range(150)]
    bad = ["", "()", "MIT OR", "MIT ISC", "(MIT", "MIT)", "OR MIT", "MIT WITH", "(MIT) WITH x", "MIT AND OR ISC", "MIT WITH x WITH y"]
    df = spark.createDataFrame([(t,) for t, _ in cases] + [(t,) for t in bad] + [(None,)], "t string")
    got = [r.c for r in df.select(licences.expression_classes(F.col("t")).alias("c")).collect()]
    assert got[: len(cases)] == [sum(1 << r for r in ranks) for _, ranks in cases]
    assert got[len(cases) :] == [None] * (len(bad) + 1)


def test_licence_names(spark):
    names = {"The MIT License": "MIT", "apache 2": "Apache-2.0", "Apache License, Version 2.0": "Apache-2.0", "GNU GPL v3+": "GPL-3.0-or-later", "lgpl-2.1 only": "LGPL-2.1-only", "agpl3": "AGPL-3.0", "new bsd": "BSD-3-Clause", " zlib ": "Zlib", "gpl-2.0+": "GPL-2.0-or-later", "Own-1": "Own-1"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", licences.licence_name(F.col("n")).alias("s")).collect()} == names
    offers = {"SEE LICENSE IN x": "proprietary", "GPL": "copyleft", "MIT/GPL-3.0": "permissive,copyleft", "unknown thing": "unknown", "UNLICENSED": "proprietary"}
    df = spark.createDataFrame([(n,) for n in offers], "n string")
    assert {r.n: r.s for r in df.select("n", F.array_join(licences.class_names(licences.offer_bits(F.col("n"))), ",").alias("s")).collect()} == offers


@pytest.mark.parametrize("most", [1, 3, 40])
def test_tier_paths_against_all_paths(spark, most):
    rng = random.Random(most)
    links = [(a, b, rng.randint(1, 9)) for a in "abcdefg" for b in "abcdefg" if a != b and rng.random() < 0.5]
    weight = {(a, b): n for a, b, n in links}
    every = []

    def walk(path, w):
        if len(path) > 1:
            every.append((-w, path))
        if len(path) < 5:
            for b in "abcdefg":
                if (path[-1], b) in weight and b not in path:
                    walk([*path, b], w + weight[path[-1], b])

    for a in "abcdefg":
        walk([a], 0)
    got = flow.tier_paths(spark.createDataFrame(links, "from_tier string, to_tier string, links long"), most).orderBy("place").collect()
    assert [(-r.weight, r.tiers) for r in got] == sorted(every)[:most]
    assert flow.tier_paths(spark.createDataFrame([], "from_tier string, to_tier string, links long")).count() == 0


@pytest.mark.parametrize(("depth", "branches", "messages"), [(6, 4, 60), (3, 2, 7), (2, 1, 100), (4, 9, 1)])
def test_sequence_flow_against_recursion(spark, depth, branches, messages):
    rng = random.Random(depth)
    names = [f"n{i}" for i in range(12)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [("n0", "n1"), ("n1", "n0"), ("n0", "gone")]
    inside = [e for e in edges if "gone" not in e]
    n_in = {n: sum(b == n for _, b in inside) for n in names}
    succ = {n: sorted((b for a, b in inside if a == n), key=lambda b: (-n_in[b], b)) for n in names}
    out, cut_off = [], []

    def dfs(node, d, way):
        if len(out) >= messages or d >= depth:
            cut_off.append(1)
            return
        if len(succ[node]) > branches:
            cut_off.append(1)
        for to in succ[node][:branches]:
            if len(out) >= messages:
                cut_off.append(1)
                return
            cycle = to in way
            out.append((node, to, d, cycle, False))
            if not cycle:
                dfs(to, d + 1, way | {to})
                if succ[to]:
                    out.append((to, node, d, False, True))

    dfs("n0", 0, {"n0"})
    got = flow.sequence_flow(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(edges, "src string, dst string"), "n0", depth, branches, messages).orderBy("step").collect()
    assert [(r.src, r.dst, r.depth, r.is_cycle, r.is_return) for r in got] == out
    assert {r.truncated for r in got} == {bool(cut_off)}


def test_commit_log_of_many_splits(spark, tmp_path):
    rng = random.Random(1)
    lines, want = ["stray.txt"], []
    for i in range(3000):
        bad = i % 17 == 5
        lines.append(f"__C__a{i % 9}@x\x1f{'' if i % 5 else 'Name'}" + ("" if bad else f"\x1f{1_600_000_000 + i}"))
        files = [f"dir\\f{rng.randrange(50)}.ts" for _ in range(rng.randrange(0, 4))]
        lines += ["\0".join(files) + "\0"] if i % 2 else [*files, ""]
        if not bad:
            want += [(f"a{i % 9}@x", "" if i % 5 else "Name", 1_600_000_000 + i, f.replace("\\", "/")) for f in files]
    lines += ["__C__last@x\x1fL\x1f1700000000", *[f"many/{k}" for k in range(400)]]  # its files reach over splits
    want += [("last@x", "L", 1_700_000_000, f"many/{k}") for k in range(400)]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    (tmp_path / "other.txt").write_text("no/header\n__C__z\x1fz\x1f5\nx")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = read_commit_log(spark, str(tmp_path))
        got = [(r.author, r.name, int(r.s), r.path) for r in df.select("author", "name", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "path").collect()]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert df.select("log", "at").distinct().groupBy("log").count().count() == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted([*want, ("z", "z", 5, "x")])


@pytest.mark.parametrize("seed", range(4))
def test_indent_parents_against_a_stack(spark, seed):
    rng = random.Random(seed)
    rows = [("p", i, rng.choice([0, 2, 2, 4, 4, 6, 3]), rng.random() < 0.6) for i in range(80)]
    want, stack = {}, []
    for _, i, k, opens in rows:
        while stack and stack[-1][1] >= k:
            stack.pop()
        want[i] = stack[-1][0] if stack else None
        if opens:
            stack.append((i, k))
    got = outline.indent_parents(spark.createDataFrame(rows, "path string, line int, indent int, o boolean"), "o").collect()
    assert {r.line: r.parent for r in got} == want


def test_go_and_python_corners(spark):
    go = "package x\n\nvar a = `func no() {`\nfunc F[T any](x T) {\n\ts := \"}\" + '}' /* } */ // }\n}\ntype (\n\tA struct {\n\t\tB int\n\t}\n\tC = map[string]func()\n)\nconst _ = 1\nfunc (r R) m() { }\r\ntype I interface {}"
    df = spark.createDataFrame([("x.go", go), ("empty.go", ""), ("null.go", None)], "path string, text string")
    got = sorted((r.start, r.end, r.name, r.kind, r.exported) for r in outline.go_symbols(df).collect())
    assert got == [(3, 3, "a", "variable", False), (4, 6, "F", "function", True), (8, 10, "A", "class", True), (11, 11, "C", "type", True), (14, 14, "m", "method", False), (15, 15, "I", "interface", True)]
    py = "def f(a=')', b=(1)):\n  pass\nclass A(B, C):\n\n\tdef g(self): x = 1\n# note\nclass D: pass\nX=1\n  Y = 2\n"
    df = spark.createDataFrame([("x.py", py), ("empty.py", ""), ("null.py", None)], "path string, text string")
    got = sorted((r.line, r.name, r.kind, r.signature, r.parent) for r in outline.python_outline(df).collect())
    assert got == [(1, "f", "function", "def f(a=')", None), (3, "A", "class", "class A(B, C)", None), (5, "g", "method", "def g(self)", 3), (7, "D", "class", "class D", None), (8, "X", "variable", "X", None)]


def test_css_corners(spark):
    sheet = "a { b: c }\n@media print {\n .x { y: z }\n}\n@supports (a: b) { .in-at { c: d } }\n.s { &:hover { e: f } g: h }\n@media (max-width: 30em) { @container c (width > 1px) { .q { r: s !important; t: u !important } } }\n.open { never: closed"
    b = css.css_blocks(spark.createDataFrame([("a.css", sheet), ("b.css", ""), ("c.css", None)], "path string, text string"))
    got = sorted((r.line, r.kind, r.prelude, r.important, r.responsive) for r in b.collect())
    assert got == [(1, "rule", "a", 0, False), (2, "media", "@media print", 0, False), (3, "rule", ".x", 0, True), (5, "rule", ".in-at", 0, False), (6, "rule", ".s", 0, False), (7, "container", "@container c (width > 1px)", 0, True), (7, "media", "@media (max-width: 30em)", 0, False), (7, "rule", ".q", 2, True), (8, "rule", ".open", 0, False)]
    assert [(r.feature, r.px) for r in css.breakpoints(b).collect()] == [("max-width", 480)]
    assert [(r.from_px, r.to_px) for r in css.media_gaps(b).collect()] == [(481, None)]
    many = " ".join(f".kebab-{c}x {{ a: b }} .camelCase{c.upper()} {{ a: b }}" for c in "abcd") + " .k { width: 1px }"
    two = css.css_blocks(spark.createDataFrame([("p", many)], "path string, text string")).withColumnRenamed("path", "project").withColumn("scope", F.lit("s"))
    found = {(r.category, r.severity, r.n) for r in css.css_findings(two, spark.createDataFrame([("p", ["x"])], "project string, deps array<string>")).collect()}
    assert found == {("naming", "low", 1), ("casing", "info", 8), ("responsive", "high", 9)}


def test_lock_corners(spark):
    none = spark.createDataFrame([("a", None), ("b", ""), ("c", "not: a lock\n  x"), ("d", "{")], "path string, text string")
    for f in (locks.pnpm_importers, locks.pnpm_packages, locks.berry_descriptors, locks.berry_importers, locks.npm_v1_packages):
        assert f(none).count() == 0, f.__name__
    text = "a:\n  'b: c':\n    d: 1 # x\n  \"e\":\n  - item\n  f: 'it''s'\ng:\n"
    got = locks.keyed_lines(spark.createDataFrame([("a", text)], "path string, text string")).orderBy("line").collect()
    assert [(r["keys"], r.value) for r in got] == [(["a"], None), (["a", "b: c"], None), (["a", "b: c", "d"], "1"), (["a", "e"], None), (["a", "f"], "it''s"), (["g"], None)]


def test_pack_dictionary_holds(spark, tmp_path):
    t = spark.createDataFrame([(str(i), f"v{i % 3}" if i % 7 else None, "same" if i % 2 else f"v{i % 3}", "x\ty") for i in range(300)], "k string, a string, b string, c string")
    path = str(tmp_path / "pack")
    pack.encode(spark, {"t": t, "none": t.limit(0)}, path, {"t": {"a": "G", "b": "G"}, "none": {"c": "H"}})
    got = pack.decode(spark, path, limits={"rows": 300, "entries": 4, "tables": 2, "columns": 4})
    assert sorted(map(tuple, got["t"].collect())) == sorted(map(tuple, t.collect())) and got["none"].count() == 0
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sum(x.startswith("@ ") for x in lines) == 4 and "@ G0 same" in lines
    for limit in ({"rows": 299}, {"entries": 3}, {"tables": 1}, {"columns": 3}, {"lines": 300}):
        with pytest.raises(ValueError, match="limit"):
            pack.decode(spark, path, limits=limit)

    def changed(name, f):
        spark.createDataFrame([(x,) for x in f(lines)], "value string").write.text(str(tmp_path / name))
        return str(tmp_path / name)

    for name, f in (("tampered", lambda x: [y.replace("@ G0 same", "@ G0 other") for y in x]), ("lost", lambda x: [y for y in x if not y.startswith("@ G1 ")]), ("unknown", lambda x: [*x, "? what"])):
        with pytest.raises(ValueError):
            pack.decode(spark, changed(name, f))
    lenient = pack.decode(spark, str(tmp_path / "lost"), strict=False)["t"]
    assert lenient.count() == 300 and lenient.where("a = 'G1' or b = 'G1'").count() > 0
    with pytest.raises(ValueError, match="letters"):
        pack.encode(spark, {"t": t}, str(tmp_path / "bad"), {"t": {"a": "G1"}})


@pytest.mark.parametrize("depth", [None, 2])
def test_reach_counts_against_searches(spark, depth):
    rng = random.Random(8)
    names = [f"n{i:03d}" for i in range(200)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(260)} | {("n000", "n000")}
    back: dict = {}
    for a, b in edges:
        back.setdefault(b, set()).add(a)
    want = {}
    for s in names:
        seen, front = {s}, {s}
        for _ in range(depth or 999):
            front = {a for n in front for a in back.get(n, ())} - seen
            seen |= front
            if not front:
                break
        if len(seen) > 1:
            want[s] = len(seen) - 1
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    n = spark.createDataFrame([(x,) for x in names], "id string")
    assert {r.id: r.reached for r in G.reach_counts(e, n, depth=depth).collect()} == want
    best = min(want, key=lambda s: (-want[s], s))
    assert [tuple(r) for r in G.blast_radius(e, n, depth).collect()] == [(best, want[best])]
    assert G.reach_counts(e, n.limit(0)).count() == 0


def test_open_items_on_a_stream(spark, tmp_path):
    """Late, repeated and out-of-order events give what the batch gives; closed keys leave the state."""
    rng = random.Random(6)
    schema = "line long, ts timestamp_ntz, action string, ckey string"
    data = [(i, f"2024-01-01 00:{i // 10:02d}:{rng.randrange(60):02d}", rng.choice(["task", "done", "other"]), rng.choice([f"k{k}" for k in range(25)] + [None])) for i in range(400)]
    data += [(10_000 + i, *data[i][1:]) for i in range(0, 400, 9)]  # repeats, some late
    (tmp_path / "in").mkdir()
    chunks = [data[k * 50 : (k + 1) * 50] for k in range(9)]
    chunks[3], chunks[4] = chunks[4], chunks[3]
    q, seen = None, {}
    names = [c.split()[0] for c in schema.split(", ")]

    def keep(df, n):
        for r in df.collect():
            seen[r.ckey] = (r.open, r.ts)

    q = LS.open_items_stream(LS.read_log_stream(spark, str(tmp_path / "in"), schema, 1), "task", "done", "2 hours").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    for k, chunk in enumerate(chunks):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in chunk))
        q.processAllAvailable()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] > 0
    late = [(20_000, "2024-01-02 00:00:00", "task", "new"), (20_001, "2024-01-02 00:00:01", "done", "new"), (20_002, "2024-01-02 09:00:00", "task", "later")]
    for k, r in enumerate(late):
        (tmp_path / "in" / f"z{k}.json").write_text(json.dumps(dict(zip(names, r, strict=True))))
        q.processAllAvailable()
    q.stop()
    batch = open_items(spark.read.schema(schema).json(str(tmp_path / "in")), "task", "done").collect()
    assert {(k, ts) for k, (open_, ts) in seen.items() if open_} == {(r.ckey, r.ts) for r in batch if r.ckey is not None} | {(k, ts) for k, (open_, ts) in seen.items() if open_ and k is None}
    closed = sum(not open_ for open_, _ in seen.values())
    assert closed and q.lastProgress["stateOperators"][0]["numRowsTotal"] < len(seen)


def test_failed_write_leaves_the_old_snapshot(spark, tmp_path):
    root, kind = str(tmp_path), "k string, n long"
    with pytest.raises(LookupError):
        snapshots.read_snapshot(spark, root, "t", kind)
    good = spark.createDataFrame([("a", 1), ("b", 2)], kind)
    first = snapshots.write_snapshot(spark, root, "s1", {"t": good, "none": good.limit(0)})
    bad = good.select("k", F.raise_error(F.lit("no")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no"):
        snapshots.write_snapshot(spark, root, "s2", {"t": good.limit(1), "u": bad})
    assert snapshots.read_snapshot(spark, root, "t", kind).count() == 2 and snapshots.read_snapshot(spark, root, "none", kind).count() == 0
    with pytest.raises(LookupError):
        snapshots.read_snapshot(spark, root, "t", kind, "s2")
    third = snapshots.write_snapshot(spark, root, "s3", {"t": good.limit(1)})
    assert snapshots.read_snapshot(spark, root, "t", kind).count() == 1 and snapshots.read_snapshot(spark, root, "t", kind, "s1").count() == 2
    gone = snapshots.prune(spark, root, 1)
    assert first in gone and third not in gone and len(gone) == 2  # the old one and the failed one
    assert [r.name for r in snapshots.snapshots(spark, root).collect()] == ["s3"] and snapshots.read_snapshot(spark, root, "t", kind).count() == 1
    marked = snapshots.with_stale(good, spark.createDataFrame([("b", 9), ("c", 3)], kind), "k").collect()
    assert sorted(map(tuple, marked)) == [("a", 1, False), ("b", 2, False), ("c", 3, True)]


def test_a_hub_is_dealt_over_tasks(spark):
    """A star of half of all edges: what it reaches is whole, and its edges are spread before the join."""
    rng = random.Random(3)
    edges = [("hub", f"n{i}") for i in range(3000)] + [(f"n{rng.randrange(3000)}", f"n{rng.randrange(3000)}") for _ in range(3000)]
    e = spark.createDataFrame(edges, "src string, dst string")
    hot = G._hubs(G.steps(e, "out"), "a")
    assert [k for k, _ in hot] == ["hub"] and hot[0][1] >= 40
    seeds = spark.createDataFrame([("hub",)], "id string")
    assert G.reach(e, seeds, "out", 1).where("hops = 1").count() == 3000
    ranks = {r.id: r.importance for r in G.pagerank(e.selectExpr("explode(array(src, dst)) as id").distinct(), e).collect()}
    assert len(ranks) == 3001 and max(ranks.values()) == 1.0
