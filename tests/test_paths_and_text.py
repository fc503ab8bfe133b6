import pytest
from pyspark.sql import functions as F

from corpuscle.functions import paths, text
from corpuscle.sources import files


def flags(spark, column, values):
    df = spark.createDataFrame([(v,) for v in values], "p string")
    return [r[0] for r in df.select(column(F.col("p"))).collect()]


def test_policy(spark):
    tests = ["tests/a.py", "src/test_a.py", "a_test.go", "x/a.test.ts", "a.spec.js", "e2e/run.ts", "test-utils/a.ts", "my-tests/a.py", "__tests__/a.js", "pkg/a_suite.rb", "SPEC/a.py", "a\\tests\\b.py"]
    assert flags(spark, paths.is_test, tests) == [True] * len(tests)
    assert not any(flags(spark, paths.is_test, ["src/contest/a.ts", "src/latest/a.py", "src/attestation/b.ts"]))
    made = ["a.min.js", "a.bundle.js", "x.generated.ts", "generated/a.py", "__generated__/a.ts", "import_map.py", "A.MIN.JS", "a\\generated\\b.py", "x/.generated/a.ts"]
    assert flags(spark, paths.is_generated, made) == [True] * len(made)
    assert not any(flags(spark, paths.is_generated, ["src/generator/a.ts", "src/min.ts"]))
    assert flags(spark, paths.is_supported, [".github/scripts/check.mjs", "src/product/target/system.ts", "dist/app.js", "target/generated.js", ".agents/a.py", "Main.kt"]) == [True, True, False, False, False, False]


def test_kinds(spark):
    assert flags(spark, paths.language, ["a.go", "a.zig", "Makefile", "x/b.tsx", ".env"]) == ["go", "zig", "unknown", "tsx", "unknown"]
    assert flags(spark, paths.category, ["a.MD", ".github/w.yml", "deploy/run.sh", "x.sql", "logo.png", "uv.lock"]) == ["docs", "config", "infra", "data", "code", "config"]
    assert flags(spark, paths.ancestors, ["a/b/c.py", "c.py"]) == [["a", "a/b"], [""]]
    assert flags(spark, paths.depth, ["a/b/c.py", ""]) == [3, 0]
    assert flags(spark, paths.module_name, ["a/b/__init__.py", "a/c.py"]) == ["a.b", "a.c"]


def test_terms():
    assert text.search_terms("how the CLI parses args") == ["cli", "parses", "args"]
    assert [text.term_variants(t)[0] for t in ("entries", "classes", "files", "status", "class", "this", "gas")] == ["entry", "class", "file", "status", "class", "this", "gas"]
    assert text.definition_symbols("parse config") == ["parseConfig", "ParseConfig", "parse_config"] and text.definition_symbols("oneName") == ["oneName"]
    assert text.read_only("SELECT 1") and not text.read_only("drop table x")


@pytest.mark.parametrize(("pattern", "path", "expected"), [("src/*.ts", "src/a/b.ts", True), ("src/*.ts", "src/a.tsx", False), ("*", "x", True), ("a.b", "axb", False)])
def test_glob(spark, pattern, path, expected):
    assert flags(spark, lambda p: text.glob_filter(p, pattern), [path]) == [expected]


def test_filters_and_shapes(spark):
    assert flags(spark, lambda p: text.text_filter(p, "(["), ["a([b", "x", None]) == [True, False, False]
    assert flags(spark, lambda p: text.line_span(p)["end"], ["212-219", "x", None]) == [219, None, None]
    assert flags(spark, text.compact, ["a \n b", "y" * 300]) == ["a b", "y" * 237 + "..."]
    assert flags(spark, text.identifier_tokens, ["parseHTTPConfig_file-2"]) == [["parse", "httpconfig", "file", "2"]]
    assert flags(spark, text.first_sentence, ["One. Two.\n\nThree.", ""]) == ["One.", None]


def test_ignore_rules(spark):
    rules = ["# note", "*.log", "!keep.log", "/only/root", "folder/", "a*z"]
    got = flags(spark, lambda p: files.is_ignored_by(p, rules), ["x/b.log", "x/keep.log", "only/root/f", "x/only/root", "y/folder/f.py", "abz", "src/a.py"])
    assert got == [True, False, True, False, True, True, False]


def test_readme_manifest_and_rules():
    out = files.readme_outline("# Title\n![b](x)\n\nIntro [link](u).\n\n## Install\n\nnpm\n\n### Deep\n\nx\n\n## Use\n\nHow.\n```\n# code\n```\n### More\n\nThird\n## License\nMIT")
    assert out == [(1, "Title", "Intro link."), (2, "Use", "How."), (3, "More", None)]
    assert files.manifest("a/package.json", '{"name":"x","dependencies":{"b":"1"},"main":"i.js"}') == {"name": "x", "description": "", "dependencies": ["b"], "entries": ["i.js"]}
    assert files.manifest("pyproject.toml", '[project]\nname = "p"\ndependencies = ["Some_Lib>=1", "b"]\n[tool]\n')["dependencies"] == ["b", "some-lib"]
    assert files.rule_file("language: python\nrule:\n  pattern: print($X)\n")["rule"]["pattern"] == "print($X)"
    with pytest.raises(ValueError):
        files.rule_file("language: python\n")
