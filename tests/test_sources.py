import json

import pytest
from pyspark.sql import functions as F

from stratalens.functions import code as C
from stratalens.sources import pack, readers
from stratalens.streaming import log_stream as LS


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def texts(spark, **files):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in files.items()], "path string, text string")


def test_event_log(spark, tmp_path):
    good = {"schemaVersion": "1", "timestamp": "2024-01-01T00:00:00Z", "agent": "a", "action": "task", "confidence": 0.5, "tags": ["x"]}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(good), "", "{not json", json.dumps({"agent": "b"}), json.dumps(good | {"agent": "c"})]))
    events, errors = readers.read_events(spark, str(tmp_path))
    assert [r.agent for r in events.orderBy("line").collect()] == ["a", "c"]
    assert [r.reason for r in errors.orderBy("line").collect()] == ["not JSON", "schema"]


def test_walk(spark, tmp_path):
    for name, data in {"src/a.ts": b"\xef\xbb\xbfhi", "b.png": b"x", "node_modules/x/y.ts": b"no", ".env": b"K=1", "big.txt": b"z" * 50, "u.txt": "é".encode("utf-16")}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = rows(readers.walk(spark, str(tmp_path), 40), "path", "status", "text")
    assert got == [("b.png", "binary", None), ("big.txt", "too_large", None), ("src/a.ts", "ok", "hi"), ("u.txt", "ok", "é")]


def test_manifests_and_locks(spark):
    m = texts(spark, **{"package__json": json.dumps({"dependencies": {"a": "^1.0.0"}, "devDependencies": {"b": "2"}})})
    assert rows(readers.npm_dependencies(m), "package", "spec", "scope") == [("a", "^1.0.0", "direct"), ("b", "2", "dev")]
    lock = {"packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1.0.3"}, "apps/web": {"dependencies": {"a": "2", "c": "1"}}, "apps/web/node_modules/a": {"version": "2.1.0"}, "node_modules/c": {"version": "1.1.1"}}}
    got = readers.npm_lock_versions(texts(spark, **{"package-lock__json": json.dumps(lock)}))
    assert rows(got, "importer", "package", "version") == [("", "a", "1.0.3"), ("apps/web", "a", "2.1.0"), ("apps/web", "c", "1.1.1")]
    yarn = '# yarn lockfile v1\n\n"@x/y@^1.0.0", "@x/y@~1.2.0":\n  version "1.2.9"\n\nleft@1:\n  version "1.0.0"\n'
    assert rows(readers.yarn_lock_versions(texts(spark, yarn__lock=yarn)), "package", "spec", "version") == [("@x/y", "^1.0.0", "1.2.9"), ("@x/y", "~1.2.0", "1.2.9"), ("left", "1", "1.0.0")]


def test_pack_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("k1", "x\ty"), ("k2", None), ("k\n3", "\\N"), ("", "")], "path string, loc string")
    empty = spark.createDataFrame([], "name string, v string")
    path = str(tmp_path / "pack")
    sha = pack.encode(spark, {"files": a, "none": empty}, path)
    back = pack.decode(spark, path)
    assert set(back) == {"files", "none"} and back["none"].count() == 0
    assert rows(back["files"], "path", "loc") == rows(a, "path", "loc")
    assert pack.encode(spark, {"files": a.orderBy(F.desc("path")), "none": empty}, path + "2") == sha
    spark.read.text(path).unionAll(spark.createDataFrame([("- files k9\tz",)], "value string")).write.text(path + "3")
    with pytest.raises(ValueError, match="trailer"):
        pack.decode(spark, path + "3")


def test_change_set_lines(spark):
    added = spark.createDataFrame([("b", "99"), ("d", "40")], "path string, loc string")
    gone = spark.createDataFrame([("b",), ("c",)], "path string")
    lines = pack.encode_changes(added, gone, "files", "path")
    assert [r.value[0] for r in lines.orderBy("place").collect()] == ["x", "x", "+", "+"]
    a, d = pack.decode_changes(lines, "files", ["path", "loc"])
    assert rows(a, "path", "loc") == rows(added, "path", "loc") and rows(d, "path") == rows(gone, "path")


def test_exports(spark):
    nodes = spark.createDataFrame([("a<b",)], "id string")
    edges = spark.createDataFrame([("a<b", "c", "import")], "src string, dst string, kind string")
    assert [r.value for r in pack.graphml_lines(nodes, edges).orderBy("place").collect()] == ['<node id="a&lt;b"/>', '<edge source="a&lt;b" target="c" label="import"/>']
    cells = spark.createDataFrame([("a/b", "c", 3)], "from_group string, to_group string, n int")
    assert pack.mermaid_lines(cells).first()["value"] == "  a_b -->|3| c"


def test_markdown(spark):
    md = "# Title #\nintro words here\n```\n# not a heading\n- [ ] no\n```\n## Two\n- [ ] open [l](x.md)\n- [x] done\n| a | b |\n|---|---|\n"
    r = C.markdown_structure(texts(spark, **{"r__md": md})).first()
    assert (r.headings, r.links, r.open_items, r.done_items, r.tables, r.title) == (2, 1, 1, 1, 1, "Title")


def test_code_scanners(spark):
    py = texts(spark, a__py='import os, sys.path as p\nfrom .x import a, b as c\nfrom .x import d\nK = os.environ["KEY"]\nv = os.getenv("VAR", "dflt")\n@app.get("/items")\n@bp.route("/f", methods=["GET", "POST"])\n')
    assert rows(C.python_imports(py), "specifier", "names") == [(".x", ["a", "b", "d"]), ("os", ["*"]), ("sys.path", ["*"])]
    assert rows(C.env_reads(py), "name", "access", "default", "line") == [("KEY", "required", None, 4), ("VAR", "optional", "dflt", 5)]
    assert rows(C.routes(py), "framework", "method", "route") == [("fastapi", "GET", "/items"), ("flask", "GET", "/f"), ("flask", "POST", "/f")]
    ts = texts(spark, a__ts="import x from './x';\nimport type { T } from './t';\nexport * from './e';\nconst y = require('y');\nconst z = import('./z');\nimport './side';")
    assert rows(C.script_imports(ts), "specifier", "kind") == [("./e", "import"), ("./side", "import"), ("./t", "type-import"), ("./x", "import"), ("./z", "dynamic-import"), ("y", "import")]
    go = texts(spark, a__go='import "fmt"\nimport (\n  "os"\n  x "a/b"\n)\n')
    assert rows(C.go_imports(go), "specifier") == [("a/b",), ("fmt",), ("os",)]


def test_schema_scanners(spark):
    sql = texts(spark, a__sql="-- create table no (x int)\nCREATE TABLE IF NOT EXISTS app.users (id int primary key, name varchar(10, 2), org_id int references orgs(id), primary key (id));")
    r = C.ddl_tables(sql).first()
    assert (r.name, r.columns, r.references) == ("app.users", ["id", "name", "org_id"], ["orgs"])
    tf = texts(spark, a__tf='resource "aws_vpc" "main" {\n}\nresource "aws_subnet" "s" {\n  vpc = aws_vpc.main.id\n  x = aws_other.no.id\n}\n')
    assert rows(C.hcl_resources(tf), "id", "references") == [("aws_subnet.s", ["aws_vpc.main"]), ("aws_vpc.main", None)]
    css = texts(spark, a__css="/* c */ .a { color: red } .a{color:blue !important} .b{x:y} .b { x:y } #id .a:hover, p::before { z: 1 }")
    rules = C.css_rules(css)
    assert rows(C.css_conflicts(rules), "selector", "state") == [(".a", "conflict"), (".b", "duplicate")]
    assert {(r.selector, tuple(r.specificity)) for r in rules.collect()} >= {("#id .a:hover", (1, 2, 0)), ("p::before", (0, 0, 2))}
    assert spark.range(1).select(C.frameworks(F.array(F.lit("next"), F.lit("react"), F.lit("left-pad"))).alias("f")).first()["f"] == ["Next.js", "React"]


def test_streaming_twin_agrees_with_batch(spark, tmp_path):
    from stratalens.operators.log import latest_by_key

    schema = "line long, ts timestamp_ntz, action string, ckey string, text string"
    data = [(i, f"2024-01-0{1 + i % 3} 00:00:0{i % 5}", "task" if i % 2 else "done", f"k{i % 4}", str(i)) for i in range(40)]
    names = [c.split()[0] for c in schema.split(", ")]
    for k in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in data[k::4]))
    stream = LS.latest_state(LS.read_log_stream(spark, str(tmp_path / "in"), schema, 1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest_state").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = latest_by_key(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert rows(spark.table("latest_state"), "action", "ckey", "text") == rows(batch, "action", "ckey", "text")
    seen = []
    w = LS.watch(spark, str(tmp_path / "in"), schema, lambda df, n: seen.append(df.count()), str(tmp_path / "cp2"))
    w.processAllAvailable()
    w.stop()
    assert sum(seen) == 40
