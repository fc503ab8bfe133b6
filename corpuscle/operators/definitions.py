"""Definitions: syntax and pattern lanes in one relation, callables, languages no scanner parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import fixed, paths, text
from corpuscle.operators import search

#: What declares a name, by suffix, in languages that have no scanner; group 1 is the name.
FUNCTION_WORDS = r"(?:func|fun|fn|def|defp|function|sub|proc)"
TYPE_WORDS = r"(?:class|struct|enum|interface|trait|type|object|protocol|record|module|defmodule)"
BACKEND_DEFS = "label string, name string, file_path string, start_line int, end_line int"


#: Words that may stand before a declaration, words that declare something to call, and words that bind a name.
MODIFIERS = ("export", "default", "abstract", "async", "declare", "public", "protected", "private", "static", "override", "readonly")
DECLARING, BINDING = ("function", "class", "def"), ("const", "let", "var")


def is_callable(content: Column, symbol: str) -> Column:
    """Whether a line declares a function, class or method of this name, or binds the name to a function.

    Modifiers go first. Then the name stands by itself (a method's head), or after a declaring
    word, or after a binding word with a function as its value: ``function``, one parameter and
    an arrow, or a list of parameters that has an arrow after it or goes on in the next line.
    """
    line = F.regexp_replace(F.trim(content), rf"^(?:(?:{'|'.join(MODIFIERS)})\s+)+", "")
    first, second = (F.regexp_extract(line, r"^([\w$]+)(?:\s+([\w$]+))?", k) for k in (1, 2))
    value = F.trim(F.regexp_extract(line, r"^[^=]*=(.*)$", 1))
    value = F.regexp_replace(value, r"^async\b\s*", "")
    plain = F.regexp_replace(value, r"^<[^=]*>\s*", "")
    listed = F.startswith(plain, F.lit("(")) & (F.contains(plain, F.lit("=>")) | ~F.contains(plain, F.lit(")")))
    function = value.rlike(r"^function\b") | value.rlike(r"^[A-Za-z_$][\w$]*\s*=>") | listed
    declared = first.isin(*DECLARING) & (second == symbol)
    bound = first.isin(*BINDING) & (second == symbol) & function
    return F.coalesce((first == symbol) | declared | bound, F.lit(False))


def union_without(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``first`` and those of ``second`` at places that ``first`` lacks; a place counts once."""
    rest = second.join(first.select(*key).distinct(), key, "left_anti")
    return first.withColumn("lane", F.lit("syntax")).unionByName(rest.withColumn("lane", F.lit("pattern"))).dropDuplicates(key)


def symbol_definitions(files: DataFrame, fact_rows: DataFrame, symbols: list[str], callable_only: bool = False, include_tests: bool = False) -> DataFrame:
    """(path, line, col, symbol, text, lane): what scanners found, and lines that look like definitions elsewhere."""
    low = [s.lower() for s in symbols]
    some = files.where(text.contains_any(F.lower("text"), low))
    if not include_tests:
        some = some.where(~F.coalesce(paths.is_test(F.col("path")), F.lit(False)))
    rows = search.lines(some).where(text.contains_any(F.lower("content"), low))
    hits = F.array_compact(F.array(*(F.when(F.col("content").rlike(search.definition_pattern(s)), F.lit(s)) for s in symbols)))
    found = rows.select("path", "line", "content", F.explode(hits).alias("symbol"))
    scanned = fact_rows.where(F.col("kind").isin("function", "class") & F.col("name").isin(*symbols)).select("path", "line", F.col("name").alias("symbol")).distinct()
    syntax = rows.join(scanned, ["path", "line"]).select("path", "line", "content", "symbol")
    both = union_without(syntax, found, ["path", "line", "symbol"])
    if callable_only:
        keep = F.lit(False)
        for s in symbols:
            keep = keep | (F.col("symbol") == s) & is_callable(F.col("content"), s)
        both = both.where(keep)
    at = F.expr("locate(lower(symbol), lower(content))")
    return both.select("path", "line", at.alias("col"), "symbol", text.compact(F.col("content")).alias("text"), "lane").dropDuplicates(["path", "line", "col"])


def unparsed_definitions(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """(label, name, file_path, start_line, end_line): definitions in languages without a scanner, by their keywords.

    A definition ends before the next one of its file, or at the file's last line.
    """
    p = F.col("path")
    eligible = F.lower(paths.suffix(p)).isin(*fixed.UNPARSED_SUFFIXES) & ~paths.is_ignored(p) & ~paths.is_generated(p) & (F.lit(include_tests) | ~paths.is_test(p))
    kind = rf"^\s*(?:(?:pub(?:\([a-z]+\))?|public|private|protected|internal|static|final|abstract|async|export|open|override|sealed|data)\s+)*({FUNCTION_WORDS}|{TYPE_WORDS})\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"
    rows = search.lines(files.where(F.coalesce(eligible, F.lit(False)))).withColumn("word", F.regexp_extract("content", kind, 1)).withColumn("name", F.regexp_extract("content", kind, 2))
    w = Window.partitionBy("path").orderBy("line")
    spans = rows.where("name <> ''").withColumn("_next", F.lead("line").over(w))
    lengths = files.select("path", search.line_count(F.col("text")).alias("_n"))
    label = F.when(F.col("word").rlike(f"^{FUNCTION_WORDS}$"), "Function").otherwise("Class")
    return spans.join(lengths, "path").select(label.alias("label"), "name", F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.coalesce(F.col("_next") - 1, F.col("_n")).alias("end_line"))


def eligible_definitions(rows: DataFrame, files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Foreign definition rows (BACKEND_DEFS) that count: named, placed, in a code file that exists and no scanner parses."""
    p = F.col("file_path")
    there = rows.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    counts = (F.trim("name") != "") & (F.col("start_line") >= 1) & ~paths.is_supported(p) & ~paths.is_ignored(p) & ~paths.is_generated(p) & (paths.category(p) == "code") & (F.lit(include_tests) | ~paths.is_test(p))
    span = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    return there.where(F.coalesce(counts, F.lit(False))).select("label", "name", "file_path", "start_line", span.cast("int").alias("span"))


def counted_languages(rows: DataFrame, files: DataFrame, scanned_bytes: DataFrame, least: float = 0.01) -> DataFrame:
    """(suffix, n_bytes): suffixes of defined files that have a function and at least this share of all source bytes.

    ``files``: path, n_bytes; ``scanned_bytes``: one row with n_bytes of what scanners parse.
    """
    own = rows.groupBy(F.col("file_path").alias("path")).agg(F.max((F.col("label").isin("Function", "Method")).cast("int")).alias("calls")).join(files.select("path", "n_bytes"), "path")
    sums = own.groupBy(paths.suffix(F.col("path")).alias("suffix")).agg(F.sum("n_bytes").alias("n_bytes"), F.max("calls").alias("calls")).where("calls = 1")
    whole = sums.agg(F.sum("n_bytes").alias("_here")).crossJoin(F.broadcast(scanned_bytes.select(F.col("n_bytes").alias("_there"))))  # one row each
    return sums.crossJoin(F.broadcast(whole)).where(F.col("n_bytes") >= least * (F.coalesce("_here", F.lit(0)) + F.coalesce("_there", F.lit(0)))).select("suffix", "n_bytes")


def unscanned_languages(files: DataFrame) -> DataFrame:
    """(language): distinct languages of paths that no scanner parses; without a suffix, ``unsuffixed files``."""
    p = F.col("path")
    name = F.when(paths.suffix(p) == "", "unsuffixed files").otherwise(paths.language(p))
    return files.where(~paths.is_supported(p)).select(name.alias("language")).distinct()


def test_like(*values: Column) -> Column:
    """Whether name, qualified name or path of a row reads like a test; ``testParser`` does, ``testament`` doesn't."""
    joined = F.concat_ws(" ", *values)
    words = r"(?i)(^|[./_-])(__tests__|tests|specs|e2e|test-support|test_support)([./_-]|$)|(^|[./_-])test_[^/]*|[._-](test|spec|suite)\.[cm]?[jt]sx?$|[._-]test-support[._-]"
    return joined.rlike(words) | joined.rlike(r"(^|[._-])[Tt]est[A-Z_]")
