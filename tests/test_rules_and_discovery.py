import pytest
from pyspark.sql import functions as F

from corpuscle import cli
from corpuscle.functions import text
from corpuscle.operators import bounded, definitions, match, overview, profiles, stats, trees
from corpuscle.sources import files as sources

PY = "def run(x):\n    return helper(x)\n\n\nclass A:\n    def go(self):\n        print(helper(1))\n\n\nhelper(2)\n"


def test_rules(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.ts", "function f(a) { return g(a); }\ng(1);\n")], "path string, text string")

    def lines(rule, language="python"):
        return [r.line for r in trees.rule_matches(files, rule, language).orderBy("line", "col").collect()]

    assert lines({"kind": "function_definition"}) == [1, 6]
    assert lines({"pattern": "helper($A)", "inside": {"kind": "class_definition", "stopBy": "end"}}) == [7]
    assert lines({"kind": "function_definition", "has": {"pattern": "print($A)", "stopBy": "end"}}) == [6]
    assert lines({"any": [{"pattern": "helper(2)"}, {"pattern": "print($A)"}]}) == [7, 10]
    assert lines({"all": [{"pattern": "helper($A)"}, {"regex": "[12]"}]}) == [7, 10]
    assert lines({"pattern": "helper($A)", "not": {"pattern": "helper(x)"}}) == [7, 10]
    assert lines({"pattern": "g($A)", "inside": {"kind": "function_declaration", "stopBy": "end"}}, "typescript") == [1]
    for broken in ({}, {"kind": "no_such_kind"}, {"has": {"pattern": "x"}}):
        with pytest.raises(ValueError):
            trees.rule_matches(files, broken, "python")


def test_rule_files():
    rule = sources.rule_file("# a rule\nlanguage: python\nrule:\n  any:\n    - pattern: print($A)\n    - kind: call\n      inside:\n        kind: class_definition\n")
    assert rule == {"language": "python", "rule": {"any": [{"pattern": "print($A)"}, {"kind": "call", "inside": {"kind": "class_definition"}}]}}
    with pytest.raises(ValueError):
        sources.rule_file("language: python\n")


def test_ignore_files_of_all_levels(spark, tmp_path):
    tree = {".gitignore": "*.gen.py\n/secret\n", "a.py": "x", "a.gen.py": "x", "secret/b.py": "x", "lib/.gitignore": "!keep.gen.py\nlocal/\n# no\n", "lib/keep.gen.py": "x", "lib/other.gen.py": "x", "lib/local/c.py": "x", "local/d.py": "x", "node_modules/e.py": "x"}
    for name, body in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert {r.path for r in sources.read_files(spark, str(tmp_path)).collect()} == {"a.py", "lib/keep.gen.py", "local/d.py"}


def test_describe_in_slices(spark):
    rows = [(k, float(v)) for k in (1, 2) for v in (list(range(1000)) if k == 1 else [7.0])] + [(3, None), (3, float("nan")), (None, 2.0), (None, 4.0)]
    got = {r.k: r for r in stats.describe(spark.createDataFrame(rows, "k int, v double"), "v", ["k"]).collect()}
    assert (got[1].n, got[1].p25, got[1].p50, got[1].p90, got[1].high) == (1000, 249.75, 499.5, 899.1, 999.0)
    assert (got[2].p25, got[2].p90, got[2].std) == (7.0, 7.0, 0.0) and got[None].p50 == 3.0 and 3 not in got
    empty = stats.describe(spark.createDataFrame([], "v double"), "v").first()
    assert (empty.n, empty.p50, empty.high) == (0, 0.0, 0.0)


def test_match_records():
    row = {"path": "a.py", "line": 3, "col": 5, "end_line": 4, "text": "f(1,\n  2)", "bindings": "{}"}
    assert match.match_json(row)["range"] == {"start": {"line": 2, "column": 4}, "end": {"line": 3, "column": 4}}


def test_reasons_and_exit_codes(tmp_path, capsys):
    assert cli.readable_reason('{"outcome": "timeout", "hint": "retry"}') == "timeout: retry"
    assert cli.readable_reason('{"hint": "retry"}') == "retry" and cli.readable_reason("[1]") == "[1]" and cli.readable_reason("plain\nmore") == "plain"
    (tmp_path / "a.py").write_text(PY)
    root = ["--project-root", str(tmp_path)]
    assert cli.main([*root, "search", "match", "--pattern", "helper($A)", "--lang", "cobol"]) == 127
    assert cli.main([*root, "search", "rule", "--rule", str(tmp_path / "none.yml")]) == 2
    assert cli.main([*root, "--json", "search", "match", "--pattern", "helper($A)"]) == 0
    assert '"total"' in capsys.readouterr().out


def test_terms_and_prefixes(spark):
    assert [text.term_variants(t) for t in ("queries", "classes", "boxes", "paths", "class", "bus", "this", "cats")] == [["query", "queries"], ["class", "classes"], ["box", "boxes"], ["path", "paths"], ["class"], ["bus"], ["this"], ["cats"]]
    assert text.definition_symbols("run helper now") == ["runHelperNow", "RunHelperNow", "run_helper_now"] and text.definition_symbols("run_it") == ["run_it"] and text.definition_symbols("a b") == []
    rows = spark.createDataFrame([("abcd", "abxd"), ("a", "abc"), ("é1", "é2"), ("", "x"), ("same", "same")], "a string, b string")
    assert [r[0] for r in rows.select(text.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 1, 1, 0, 4]
    assert rows.where(text.text_filter(F.col("a"), "(?<x")).count() == 0


def test_small_operators(spark):
    calls = spark.createDataFrame([("a.get",), ("m.load",), ("m.load",), ("#x",)], "target string")
    assert [tuple(r) for r in overview.most_called(calls).collect()] == [("m.load", 2, 0.5)]
    names = spark.createDataFrame([(["a/b/c.py", "a/b/d/e.py"],), (["a/x.py", "b/y.py"],), (["src/x.py"],), ([],)], "f array<string>")
    assert [r[0] for r in names.select(overview.common_owner(F.col("f"))).collect()] == ["a/b", None, None, None]
    tiers = spark.createDataFrame([(f"p{i:02}", i // 5) for i in range(30)], "path string, tier int")
    got = bounded.leading_tiers(tiers, ["tier"], 7, 100).collect()
    assert len(got) == 10 and not got[0].bounded
    assert [r.bounded for r in bounded.leading_tiers(tiers, ["tier"], 7, 8).collect()] == [True] * 8
    go = spark.createDataFrame([("cmd/run.go", "package main\nfunc Run() {\n}\ntype Options struct {\n}\n")], "path string, text string")
    assert [tuple(r) for r in definitions.unparsed_definitions(go).orderBy("start_line").collect()] == [("Function", "Run", "cmd/run.go", 2, 3), ("Class", "Options", "cmd/run.go", 4, 5)]
    docs = spark.createDataFrame([("a.py", "function", "main", "main", 9, None), ("a.py", "function", "other", "other", 1, "Doc."), ("b.py", "method", "__init__", "C.__init__", 1, "D")], "path string, kind string, name string, qualified_name string, line int, docstring string")
    assert [r.qualified_name for r in profiles.likely_mains(docs).collect()] == ["other", "C.__init__", "main"]
