import pytest
from pyspark.sql import functions as F

from corpuscle.engine import Engine
from corpuscle.operators import graph, match, scan_python, scan_script, search
from sources import SOURCES


def tree(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_coverage_and_windows(spark):
    far = "retry\n" + "x\n" * 80 + "backoff\n" + "x\n" * 3 + "budget retry\n"
    files = tree(spark, [("src/z.py", "x\n" * 35 + "the retry backoff here\nbudget\n"), ("src/a.py", far), ("src/b.py", "retry\nbackoff\nbudget budget\n"), ("src/c.py", "none")])
    spans = {r.path: (r.start, r.end, r.span) for r in search.cohesive_windows(files, "retry backoff budget").collect()}
    assert spans == {"src/z.py": (36, 37, 2), "src/a.py": (82, 86, 5)}
    ranked = [r.path for r in search.ranked_coverage(files, "retry backoff budget").collect()]
    assert ranked == ["src/z.py", "src/a.py", "src/b.py"]
    assert search.decisive(files, "retry backoff budget") == ["src/z.py", "src/a.py"]
    assert search.decisive(files, "retry") is None
    assert {(r.path, r.line) for r in search.anchors(files, search.cohesive_windows(files, "retry backoff budget"), "retry backoff budget").collect()} == {("src/z.py", 36), ("src/z.py", 37), ("src/a.py", 82), ("src/a.py", 86)}


def test_literal_rows(spark):
    files = tree(spark, [("a.py", "é Foo\r\nfoo\nFOO"), ("b.py", "bar"), ("c.py", None)])
    assert [(r.path, r.line, r.col) for r in search.literal_matches(files, "foo").orderBy("line").collect()] == [("a.py", 1, 4), ("a.py", 2, 1)]


def test_graph_operators(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("d", "d", 1)], "source string, target string, weight long")
    assert {(r.node, r.degree, r.fan_in, r.fan_out) for r in graph.degrees(edges).collect()} == {("a", 2, 1, 1), ("b", 2, 1, 1), ("c", 2, 1, 1), ("d", 1, 1, 1)}
    assert {(r.node, r.reach) for r in graph.two_hop(edges).collect()} == {("a", 2), ("b", 2), ("c", 2), ("d", 1)}
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop) for r in graph.reach(edges, start, lambda df: df.checkpoint()).collect()} == {("b", 1), ("c", 2)}
    assert graph.k_hops(edges.limit(0), start, 3).count() == 0


def test_python_scan_survives_broken_files():
    facts = scan_python.scan("def a(:\n  pass\nfrom ..x import y, z as q\n")
    assert facts[0][0] == "parse_error" and [f[1] for f in facts if f[0] in ("function", "from")] == ["a", "y", "z"]
    doc = {r[2]: (r[7], r[4]) for r in scan_python.documentation('class A:\n  """Doc\n  more."""\n  def f(self):\n    b"no"\n  def g(self): \'a\' "b"\n')}
    assert doc["A"][0].startswith("Doc") and doc["A.f"][0] is None and doc["A.g"][0] == "ab"


def test_script_scan_skips_text_that_only_looks_like_code():
    facts = scan_script.scan("const r = /function x() {/; // function y() {}\nconst s = `function z() {`;\nexport default function main() { return go(1); }\n")
    assert [f[1] for f in facts if f[0] == "function"] == ["main"] and [(f[5], f[1]) for f in facts if f[0] == "call"] == [("main", "go")]


def test_patterns(spark):
    files = tree(spark, [("a.py", "print(x, y)\nprint(f(1)[2])\n# print(z)\nq = 'print(w)'\nif a == a: pass\n"), ("b.ts", "foo.bar(1, [2, 3]); // foo.bar(9)")])
    assert [(r.line, r.col) for r in match.matches(files, "print($$$A)", "python").collect()] == [(1, 1), (2, 1)]
    assert [r.line for r in match.matches(files, "print($A)", "python").collect()] == [2]
    assert [r.line for r in match.matches(files, "$X == $X").collect()] == [5]
    assert [r.text for r in match.matches(files, "foo.bar($A, $B)").collect()] == ["foo.bar(1, [2, 3])"]


@pytest.fixture(scope="module")
def engine(spark):
    with Engine(tree(spark, sorted(SOURCES.items()))) as e:
        yield e


def test_engine_search(engine):
    assert engine.search("pkg/util.py")[0] == {"lane": "path", "path": "pkg/util.py"}
    assert engine.search("run helper")[0]["path"] == "pkg/core.py"
    assert engine.search("Runner.stop") == [{"lane": "member", "path": "pkg/core.py", "line": 18}]
    assert engine.search("Square")[0]["lane"] == "definition"
    assert engine.search("zzzz") == []
    assert engine.search("helper", lane="graph", label="function")[0]["id"] == "function:pkg/util.py:helper"
    assert engine.search("runs things", lane="semantic")[0]["id"] == "pkg/core.py:Runner"
    assert [c["line"] for c in engine.calls("helper")] == [12]
    assert engine.rule("language: python\nrule:\n  pattern: helper($X)\n")[0]["path"] == "pkg/util.py"


def test_engine_views(engine):
    signals = engine.signals("all")
    assert signals["longest_functions"][0]["identifier"] == "pkg/core.py::Runner.run" or signals["longest_functions"][0]["lines"] == 5
    assert signals["relationships"]["files"] == 8 and signals["docstrings"]["class"]["present"] == 2
    with pytest.raises(ValueError):
        engine.signals("nope")
    seen = engine.inspect("pkg")
    assert ("main.py", "pkg/core.py", "in") in {(b["source"], b["target"], b["direction"]) for b in seen["boundary"]} and seen["entries"]
    node = engine.inspect("multiply")
    assert node["trace"] == [{"node": "function:web/area.ts:area", "direction": "caller", "hop": 1}] and node["snippet"].startswith("function multiply")
    summary = engine.summary()
    assert summary["readme"] == [{"level": 1, "heading": "Title", "content": "Prose."}] and summary["languages"][0]["language"] in ("python", "typescript")
    assert engine.schema()["types"] == {"imports": 8, "contains": 12, "calls": 4}
    assert engine.query("SELECT count(*) AS n FROM files") == [{"n": 9}]
    with pytest.raises(ValueError):
        engine.query("DROP TABLE files")
    changed = engine.files.withColumn("text", F.when(F.col("path") == "pkg/util.py", "x = 1").otherwise(F.col("text")))
    assert ("pkg/core.py", 1) in {(r["node"], r["hop"]) for r in engine.changes(changed)}


def test_every_config_counts(spark):
    rows = []
    for i in range(10_050):
        rows += [(f"d{i}/tsconfig.json", '{"extends": "./base.config"}' if i < 5 else f'{{"compilerOptions": {{"paths": {{"@x": ["./x.ts"]}}}}}} // {i}'), (f"d{i}/a.ts", 'import { x } from "@x";'), (f"d{i}/x.ts", "export const x = 1;")]
    rows += [(f"d{i}/tsconfig.base.json", "{}") for i in range(5)] + [("d0/base.config.json", "{}"), ("ring/tsconfig.json", '{"extends": "./jsconfig"}'), ("ring/jsconfig.json", '{"extends": "./tsconfig.json"}'), ("ring/a.ts", 'import "@x";')]
    with Engine(spark.createDataFrame(rows, "path string, text string")) as engine:
        assert {(r.source, r.target) for r in engine.resolved.collect()} == {(f"d{i}/a.ts", f"d{i}/x.ts") for i in range(5, 10_050)}


def test_nearest_config_and_what_it_rests_on(spark):
    rows = [("tsconfig.json", '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*"]}}}'), ("app/tsconfig.json", '{"extends": "./config/mid"}'), ("app/config/mid.json", '{"extends": "../../tsconfig.base.json"}'), ("tsconfig.base.json", '{"compilerOptions": {"paths": {"@/*": ["lib/*"],}}}')]
    rows += [("app/x/a.ts", 'import "@/u";'), ("b.ts", 'import "@/u";'), ("src/u.ts", ""), ("lib/u.ts", ""), ("app/lib/u.ts", "")]
    with Engine(spark.createDataFrame(rows, "path string, text string")) as engine:
        assert {(r.source, r.target) for r in engine.resolved.collect()} == {("app/x/a.ts", "lib/u.ts"), ("b.ts", "src/u.ts")}
