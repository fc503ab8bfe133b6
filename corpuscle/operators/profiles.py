"""Profiles of directories, files, variables and symbols; which documentation to show first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import fixed, paths, text


def directory_profile(profiles: DataFrame, directory: str) -> DataFrame:
    """(files, defines, imports_local) of the profiled files in a directory; one row."""
    inside = profiles.where(paths.within(F.col("file"), F.lit(directory)))
    return inside.agg(F.count("*").alias("files"), F.coalesce(F.sum("defines"), F.lit(0)).alias("defines"), F.coalesce(F.sum("imports_local"), F.lit(0)).alias("imports_local"))


def dense_files(profiles: DataFrame, directory: str, limit: int) -> DataFrame:
    """The profiled files of a directory with the highest totals, ties by path."""
    return profiles.where(paths.within(F.col("file"), F.lit(directory))).orderBy(F.desc("total"), "file").limit(limit)


def largest_files(inventory: DataFrame, directory: str, limit: int) -> DataFrame:
    """(path, n_lines, language, category) of a directory's longest files, without parsing any."""
    inside = inventory.where(paths.within(F.col("path"), F.lit(directory)))
    return inside.select("path", "n_lines", "language", "category").orderBy(F.desc("n_lines"), "path").limit(limit)


def import_specifiers(fact_rows: DataFrame, path: str) -> DataFrame:
    """(specifier, first): what a file names in its imports and re-exports, unresolved, at the first line of each."""
    kinds = F.when(F.col("kind") == "reexport", F.concat(F.lit("re-export "), F.col("identifier"))).otherwise(F.col("identifier"))
    rows = fact_rows.where((F.col("path") == path) & F.col("kind").isin("import", "reexport") & (F.col("identifier") != ""))
    return rows.groupBy(kinds.alias("specifier")).agg(F.min("line").alias("first"))


def variable_profile(variables: DataFrame, profiles: DataFrame, target: str) -> DataFrame:
    """(identifier, line, scope, file, total): definitions of a variable by name or by ``file::name``, with their file's profile."""
    named = variables.where((F.col("name") == target) | F.endswith("identifier", F.lit("::" + target)))
    return named.join(profiles.select("file", "total"), "file", "left").select("identifier", "line", "scope", "file", "total")


def filled_lengths(metrics: DataFrame, inventory: DataFrame) -> DataFrame:
    """Metrics (file, lines, ...) of files of the inventory; a length of zero is taken from there."""
    joined = metrics.join(inventory.select(F.col("path").alias("file"), "n_lines"), "file")
    return joined.withColumn("lines", F.coalesce(F.nullif("lines", F.lit(0)), "n_lines")).drop("n_lines")


def symbol_docstrings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, name, kind, line, docstring) for wanted (path, name, kind, line): the matching definition's.

    A line of 0 takes any. A class's documentation answers only for kind ``class``; a function's
    for ``function``, functions before methods, the earliest first; a definition without
    documentation is passed over.
    """
    own = docs.where("kind <> 'file' AND docstring IS NOT NULL").select("path", "name", F.col("kind").alias("_kind"), F.col("line").alias("_line"), "docstring")
    fits = (F.when(F.col("kind") == "class", F.col("_kind") == "class").otherwise(F.col("_kind") != "class")) & ((F.col("line") <= 0) | (F.col("line") == F.col("_line")))
    first = F.struct((F.col("_kind") == "method").alias("m"), F.col("_line").alias("l"))
    rows = wanted.join(own, ["path", "name"]).where(fits)
    found = rows.groupBy("path", "name", "kind", "line").agg(F.min_by("docstring", first).alias("docstring"))
    return wanted.join(found, ["path", "name", "kind", "line"], "left")


def descriptions(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, line, description): first sentence of the function's, else the class's documentation, else the file's."""
    def lookup(kind: str) -> DataFrame:
        return symbol_docstrings(docs, symbols.select("path", "name", F.lit(kind).alias("kind"), "line")).select("path", "name", "line", F.col("docstring").alias(kind))

    overview = docs.where("kind = 'file' AND docstring IS NOT NULL").groupBy("path").agg(F.min(text.preview(F.col("docstring"))).alias("_file"))
    rows = symbols.select("path", "name", "line").join(lookup("function"), ["path", "name", "line"], "left").join(lookup("class"), ["path", "name", "line"], "left").join(overview, "path", "left")
    return rows.select("path", "name", "line", F.coalesce(text.first_sentence(F.coalesce("function", "class")), text.first_sentence(F.col("_file"))).alias("description"))


def priority(name: Column, docstring: Column) -> Column:
    """What to show first of functions: documented, no dunder, main names, main beginnings, others, private ones."""
    low = F.lower(name)
    dunder = F.startswith(low, F.lit("__")) & F.endswith(low, F.lit("__"))
    begins = F.lit(False)
    for prefix in fixed.MAIN_PREFIXES:
        begins = begins | F.startswith(low, F.lit(prefix))
    rank = F.when(low.isin(*fixed.MAIN_NAMES), 0).when(begins, 1).when(F.startswith(low, F.lit("_")), 3).otherwise(2)
    has = F.coalesce(F.trim(docstring) != "", F.lit(False))
    return F.struct((~has).cast("int").alias("without"), dunder.cast("int").alias("dunder"), rank.alias("rank"))


def likely_mains(docs: DataFrame, per_corpus: int = 6, files: int = 3) -> DataFrame:
    """(path, qualified_name, line): functions and methods to name first, of at most three files and six in all."""
    rows = docs.where("kind IN ('function', 'method')").withColumn("_p", priority(F.col("name"), F.col("docstring")))
    order = [F.col("_p"), F.col("line"), F.col("path"), F.col("qualified_name")]
    # the best of each file is at most per_corpus rows of it; three files are a broadcast of three rows
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where(F.col("_r") <= per_corpus)
    chosen = best.where("_r = 1").orderBy(*order).limit(files).select("path")
    return best.join(F.broadcast(chosen), "path", "left_semi").orderBy(*order).limit(per_corpus).select("path", "qualified_name", "line")


def documentation_focus(docs: DataFrame, profiles: DataFrame, files: int = 3) -> DataFrame:
    """(path, kind, total, present): documented definitions of the files of highest score."""
    chosen = profiles.where("score > 0").orderBy(F.desc("score"), "file").limit(files).select(F.col("file").alias("path"))
    rows = docs.where("parse_error IS NULL").join(F.broadcast(chosen), "path", "left_semi")
    return rows.groupBy("path", "kind").agg(F.count("*").alias("total"), F.count("docstring").alias("present"))


def symbols_by_name(fact_rows: DataFrame) -> DataFrame:
    """(name, path, line): function spans, then exported names that their file has no span for, at line 0."""
    spans = fact_rows.where("kind = 'function'").select("name", "path", "line")
    names = fact_rows.where("kind = 'export'").select("name", "path").distinct().join(spans.select("name", "path"), ["name", "path"], "left_anti")
    return spans.unionByName(names.withColumn("line", F.lit(0)))


def relationship_counts(rows: DataFrame) -> DataFrame:
    """One row of counts over profiled files: file, entry, imports_local, relative, reexports_local, extends, inherits."""
    python = F.endswith("file", F.lit(".py"))

    def total(column: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))

    return rows.agg(
        F.count("*").alias("files"), total("imports_local", python).alias("python_imports"), total("imports_local", ~python).alias("script_imports"), F.count_if("entry").alias("entrypoints"),
        total("relative", ~python).alias("script_relative"), total("relative", python).alias("python_relative"), total("reexports_local", ~python).alias("script_reexports"),
        total("inherits", python).alias("python_inheritance"), total("extends", ~python).alias("script_inheritance"), F.count_if(F.col("imports_local") > 0).alias("importing"))
