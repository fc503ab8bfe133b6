from pyspark.sql import functions as F

from corpuscle import cli
from corpuscle.engine import Engine
from corpuscle.functions import render
from corpuscle.sources import catalog
from corpuscle.streaming import refresh


def test_saved_projects(spark, tmp_path):
    assert list(catalog.pages(catalog.projects(spark, str(tmp_path / "c")), "name")) == []
    files = spark.createDataFrame([("a.py", "import b\n"), ("b.py", "def f():\n    pass\n")], "path string, text string")
    with Engine(files) as engine:
        row = catalog.save(engine, str(tmp_path / "c"), "one", "/here")
        assert (row["status"], row["files"], row["edges"]) == ("ready", 2, 2)
        catalog.save(engine, str(tmp_path / "c"), "two")
        pages = list(catalog.pages(catalog.projects(spark, str(tmp_path / "c")), "name", 1))
        assert [r["name"] for page in pages for r in page] == ["one", "two"] and len(pages) == 2
        assert catalog.state(spark, str(tmp_path / "c"), "one", "facts").where("kind = 'function'").first().name == "f"
    changed = files.withColumn("text", F.when(F.col("path") == "b.py", "x = 1").otherwise(F.col("text")))
    with Engine(changed) as engine:
        impact = engine.changes_since(catalog.state(spark, str(tmp_path / "c"), "one", "digests"))
        assert {(r["node"], r["hop"]) for r in impact} == {("b.py", 0), ("a.py", 1)}


def test_facts_follow_a_folder(spark, tmp_path):
    root, out = tmp_path / "root", str(tmp_path / "out")
    root.mkdir()
    (root / "a.py").write_text("def one():\n    pass\n")

    def follow():
        refresh.keep_facts(refresh.changed_files(spark, str(root)), out, str(tmp_path / "state")).awaitTermination()
        return {(r.path, r.name) for r in refresh.latest(spark, out).where("kind = 'function'").collect()}

    assert follow() == {("a.py", "one")}
    (root / "b.py").write_text("def two():\n    pass\n")
    assert follow() == {("a.py", "one"), ("b.py", "two")}


def test_windows_of_late_events(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)]
    table = spark.createDataFrame(rows, "t string, key string, value double").select(F.to_timestamp("t").alias("ts"), "key", "value")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = refresh.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(str(r.start), r.key, r.n, r.total) for r in spark.table("windows").collect()} == {("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 01:00:00", "b", 1, 4.0)}


def test_search_sinks():
    rows = [{"lane": "definition", "path": f"{i}.py", "line": i, "text": "def f()"} for i in range(1, 5)]
    lines = render.search_lines(rows, "source", 2)
    assert lines[0] == "# Definitions" and len(lines) == 4 and lines[-1] == "... at least 2 more candidates" and lines[1].startswith("- 1.py:1")
    assert render.search_lines(rows[:1], "source", 2)[-1].startswith("- 1.py:1") and render.search_lines([], "source", 2) == []


def test_sections_keep_their_order():
    lines = render.sections({"clusters": [{"label": "a"}], "languages": [{"language": "python", "share": 0.5}] * 3, "surfaces": [{"file": "a/b/index.ts"}], "roles": []}, "Summary", render.SUMMARY, 2)
    assert [x for x in lines if x.endswith(":")] == ["Languages:", "Surfaces:", "Clusters:"] and "  - ..." in lines and "    b" in lines


def test_backend_commands(tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    return f()\n")
    root, shared = ["--project-root", str(tmp_path / "src")], ["--catalog", str(tmp_path / "cat"), "--name", "p"]
    assert cli.main([*root, "index", *shared]) == 0
    assert cli.main([*root, "backend", "projects", *shared]) == 0 and "p" in capsys.readouterr().out
    assert cli.main([*root, "backend", "changes", *shared]) == 1
    assert cli.main([*root, "backend", "changes"]) == 2
    assert cli.main([*root, "backend", "status"]) == 0 and "milliseconds" in capsys.readouterr().out
    assert cli.main([*root, "search", "f"]) == 0 and "# Definitions" in capsys.readouterr().out
    assert cli.main([*root, "summary"]) == 0 and capsys.readouterr().out.startswith("# Summary")
    assert cli.main([*root, "inspect", "a.py"]) == 0 and "Profile:" in capsys.readouterr().out
