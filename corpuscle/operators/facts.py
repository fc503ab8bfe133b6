"""Fact tables of source files: one pass of a scanner over each file, flat rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import fixed, paths
from corpuscle.operators import nesting, scan_python, scan_script

FACTS = "path string, kind string, name string, identifier string, line int, span int, owner string, detail string"
DOCS = "path string, kind string, name string, qualified_name string, parent string, line int, inputs string, outputs string, docstring string, parse_error string"
METRICS = "path string, identifier string, line int, span int, cyclomatic int, cognitive int, hidden_quadratic int"


def _mapped(files: DataFrame, scan: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *fact) for path, source in zip(frame["path"], frame["text"], strict=True) for fact in scan(path, source or "")]
            yield pd.DataFrame(rows, columns=columns)

    supported = files.where(F.lower(paths.suffix(F.col("path"))).isin(*fixed.PYTHON_SUFFIXES, *fixed.SCRIPT_SUFFIXES))
    return supported.select("path", "text").mapInPandas(run, schema)


def _python(path: str) -> bool:
    return path.lower().endswith(fixed.PYTHON_SUFFIXES)


def facts(files: DataFrame) -> DataFrame:
    """All facts of the files of supported languages; others have none."""
    return _mapped(files, lambda path, source: scan_python.scan(source) if _python(path) else scan_script.scan(source), FACTS)


def documentation(files: DataFrame) -> DataFrame:
    """Documentation of files, classes, functions and methods, nesting flattened."""
    return _mapped(files, lambda path, source: scan_python.documentation(source) if _python(path) else scan_script.documentation(source), DOCS)


def metrics(files: DataFrame) -> DataFrame:
    """Complexity of the functions of Python files."""
    return _mapped(files, lambda path, source: scan_python.metrics(source) if _python(path) else [], METRICS)


def documentation_totals(docs: DataFrame) -> DataFrame:
    """(kind, total, present): definitions of files that parse, and those with documentation."""
    return docs.where("parse_error IS NULL").groupBy("kind").agg(F.count("*").alias("total"), F.count("docstring").alias("present"))


def profiles(fact_rows: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row a file: what it defines, imports, exports, extends, decorates; at most five sample names.

    ``edges``: source, target of resolved imports; ``files``: path, n_lines. A file of no
    facts has zeros.
    """
    def count(*kinds: str) -> Column:
        return F.count_if(F.col("kind").isin(*kinds))

    top = F.col("kind").isin("function") & (F.col("detail") != "nested")
    sums = fact_rows.groupBy(F.col("path").alias("file")).agg(
        (F.count_if(top) + count("class")).alias("defines"),
        count("export").alias("exports"),
        F.count_if((F.col("kind") == "base") & (F.col("detail") == "extends")).alias("extends"),
        F.count_if((F.col("kind") == "base") & (F.col("detail") != "extends")).alias("inherits"),
        count("decorator").alias("decorators"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin("function", "class"), F.struct("line", "name")))), lambda x: x["name"]), 1, 5).alias("samples"),
    )
    local = edges.where("type = 'imports'").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("imports_local"))
    joined = files.select(F.col("path").alias("file"), F.col("n_lines").alias("lines")).join(sums, "file", "left").join(local, "file", "left")
    numbers = ("defines", "imports_local", "exports", "extends", "inherits", "decorators")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    return filled.withColumn("total", sum((F.col(c) for c in numbers), F.lit(0))).withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def role() -> Column:
    """What a profiled file is likely for."""
    c = F.col
    return (
        F.when(c("entry"), "likely entrypoint")
        .when(c("file").rlike(r"(^|/)(test_|.*\.test\.|.*_test\.)"), "likely test/support")
        .when(c("file").endswith(".py") & (c("defines") >= 8), "likely script hub")
        .when((c("reexports_local") > 0) & (c("defines") == 0) & (c("imports_local") == 0), "likely barrel")
        .when(c("file").rlike(r"(types|schema|schemas)\.(ts|tsx|js|jsx|py)$"), "likely contracts")
        .when((c("defines") >= 6) | (c("defines") >= 3) & (c("imports_local") >= 2) | (c("decorators") >= 2), "likely hub")
        .when((c("exports") >= 5) & (c("imports_local") == 0) & (c("defines") <= 1), "likely contracts")
        .when(c("imports_local") >= 3, "likely integration")
        .otherwise("likely module")
    )


def score() -> Column:
    """A file's structural weight, by which documentation focuses."""
    return F.expr("defines * 5 + imports_local * 6 + (extends + inherits) * 3 + decorators * 2 + exports")


def members(defs: DataFrame, owner: str) -> DataFrame:
    """Definitions whose innermost class span is ``owner``; without a class, files named after it."""
    own = defs.where((F.col("kind") == "class") & (F.col("name") == owner) | (F.regexp_extract(paths.basename(F.col("path")), r"^([^.]+)", 1) == owner))
    defs = defs.join(own.select("path").distinct(), "path", "left_semi")  # only files that can hold a member
    d = defs.where("kind = 'function'").select("path", "name", "line", F.struct("line", "identifier").alias("_id")).distinct()
    spans = defs.where("kind = 'class'").select("path", F.col("name").alias("class"), F.col("line").alias("first"), (F.col("line") + F.col("span") - 1).alias("last"))
    inner = nesting.innermost(d, spans, ["path"], "line", "first", "last", ["class"])
    stem = F.regexp_extract(paths.basename(F.col("path")), r"^([^.]+)", 1)
    return inner.where(F.coalesce(F.col("class") == owner, stem == owner)).select("path", "name", "line")
