"""Text search over files: literal lines, definitions, term coverage, cohesive windows.

``files`` has columns path and text. Lanes are lazy DataFrames; a caller takes the
first that has rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import paths, text
from corpuscle.operators.stats import first_n_per_key

ROWS_PER_FILE = 2
WINDOW_LINES = 50
ANCHORS = 2
#: Phrases that one expression looks for.
DIRECT = 200
#: Rows up to which a side of a join is broadcast.
FEW = 100_000


def small(table: DataFrame, most: int = FEW) -> DataFrame:
    """``table``, to be broadcast if its counted rows are at most ``most``."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """(path, line, content): each line with its 1-based number."""
    return files.select("path", *keep, F.posexplode(F.split("text", r"\r?\n")).alias("_i", "content")).select("path", *keep, (F.col("_i") + 1).alias("line"), "content")


def line_count(value: Column) -> Column:
    """Lines of a text; a newline at the end begins no line."""
    return F.when((value == "") | value.isNull(), 0).otherwise(F.size(F.split(F.regexp_replace(value, "\n$", ""), "\n")))


def literal_matches(files: DataFrame, query: str, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """(path, line, col, text) of lines that hold the query, whatever its case; at most ``per_file`` of a file.

    Files without it are dropped before their lines are made. ``col`` counts bytes from 1.
    """
    q = query.lower()
    found = lines(files.where(F.contains(F.lower("text"), F.lit(q)))).where(F.contains(F.lower("content"), F.lit(q)))
    before = F.substring("content", F.lit(1), F.locate(q, F.lower("content")) - 1)
    rows = found.select("path", "line", (F.octet_length(before) + 1).alias("col"), text.compact(F.col("content")).alias("text"))
    return first_n_per_key(rows, ["path"], [F.col("line")], per_file)


def definition_pattern(symbol: str) -> str:
    """Lines that declare ``symbol`` by a keyword, or assign it at their start."""
    name = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in symbol)
    keywords = r"(?:async\s+)?(?:def|class|function|const|let|var|interface|type|enum|struct|trait|impl|fn|func|fun|module|defmodule|defp|defmacro)"
    return rf"(?i)(?:\b{keywords}\s+(?:self\.)?{name}(?![A-Za-z0-9_$])|^\s*(?:export\s+)?{name}\s*(?::[^=]+)?=(?!=))"


def definition_matches(files: DataFrame, symbol: str, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """(path, line, text) of lines that look like definitions of a symbol."""
    pattern = definition_pattern(symbol)
    found = lines(files.where(F.contains(F.lower("text"), F.lit(symbol.lower())))).where(F.col("content").rlike(pattern))
    return first_n_per_key(found.select("path", "line", text.compact(F.col("content")).alias("text")), ["path"], [F.col("line")], per_file)


def files_with(files: DataFrame, variants: list[str]) -> DataFrame:
    """Paths of files that hold any variant, whatever its case."""
    return files.where(text.contains_any(F.lower("text"), [v.lower() for v in variants])).select("path")


def owner_files(files: DataFrame, owner: str) -> DataFrame:
    """Files that declare a class of this name, or are named after it."""
    declared = files.where(F.col("text").rlike(rf"\bclass\s+{owner}(?![A-Za-z0-9_])"))
    named = files.where(F.regexp_extract(paths.basename(F.col("path")), r"^([^.]+)\.", 1) == owner)
    return declared.select("path").union(named.select("path")).distinct()


def path_matches(files: DataFrame, query: str) -> DataFrame:
    """(path, exactness): 0 the same, 1 its end, 2 a part, whatever the case."""
    low, q = F.lower("path"), query.lower()
    rank = F.when(low == q, 0).when(F.endswith(low, F.lit("/" + q)), 1).when(F.contains(low, F.lit(q)), 2)
    return files.select("path", rank.alias("exactness")).where("exactness IS NOT NULL")


def concept_paths(files: DataFrame, query: str) -> DataFrame:
    """Code files whose path names all of two or more terms, shorter paths first."""
    terms = text.search_terms(query)
    if len(terms) < 2:
        return files.select("path").limit(0)
    named = reduce(lambda a, b: a & b, [F.contains(F.lower("path"), F.lit(t)) for t in terms])
    return files.where(named & (paths.category(F.col("path")) == "code")).select("path").orderBy(F.length("path"), "path")


def coverage(files: DataFrame, query: str) -> DataFrame:
    """(path, matched, content_matched, path_rank, hits): how many terms each file holds, in one pass.

    ``matched`` counts terms of content or path; ``hits`` has one flag a term, of content.
    """
    terms = text.query_terms(query)
    low, low_path = F.lower("text"), F.lower("path")
    flags = [text.contains_any(low, v) for v in terms.values()]
    either = [f | text.contains_any(low_path, v) for f, v in zip(flags, terms.values(), strict=True)]
    count = lambda xs: reduce(lambda a, b: a + b, [x.cast("int") for x in xs])
    rank = paths.relevance(F.col("path"), text.search_terms(query))
    return files.select("path", count(either).alias("matched"), count(flags).alias("content_matched"), rank.alias("path_rank"), F.array(*flags).alias("hits")).where("content_matched > 0")


def cohesive_windows(files: DataFrame, query: str) -> DataFrame:
    """(path, start, end, span): the narrowest lines that hold all terms a file has, two of them on one line.

    Terms a file lacks are left out; files with fewer than two have no window. For each
    line the latest line of every term gives the window that ends there.
    """
    terms = text.query_terms(query)
    flags = [text.contains_any(F.lower("content"), v).alias(f"t{i}") for i, v in enumerate(terms.values())]
    holds = [text.contains_any(F.lower("text"), v).alias(f"h{i}") for i, v in enumerate(terms.values())]
    n = len(terms)
    total = reduce(lambda a, b: a + b, [F.col(f"h{i}").cast("int") for i in range(n)])
    some = files.select("path", "text", *holds).where(total >= 2)
    rows = lines(some, *(f"h{i}" for i in range(n))).select("path", "line", *(f"h{i}" for i in range(n)), *flags)
    on_line = reduce(lambda a, b: a + b, [F.col(f"t{i}").cast("int") for i in range(n)])
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.when(F.col(f"h{i}"), F.coalesce(F.max(F.when(F.col(f"t{i}"), F.col("line"))).over(upto), F.lit(0))) for i in range(n)]
    dense = F.coalesce(F.max(F.when(on_line >= 2, F.col("line"))).over(upto), F.lit(0))
    start = F.array_min(F.array(*last, dense))  # nulls, of terms the file lacks, don't count
    windows = rows.select("path", start.alias("start"), F.col("line").alias("end")).where("start > 0").withColumn("span", F.col("end") - F.col("start") + 1)
    return windows.groupBy("path").agg(F.min(F.struct("span", "end", "start")).alias("w")).select("path", "w.start", "w.end", "w.span")


def anchors(files: DataFrame, windows: DataFrame, query: str) -> DataFrame:
    """(path, line): each term's first line inside the file's window, two lines at most, in the order of terms."""
    terms = text.query_terms(query)
    rows = lines(files).join(windows.select("path", "start", "end"), "path").where("line BETWEEN start AND end")
    firsts = rows.groupBy("path").agg(*(F.min(F.when(text.contains_any(F.lower("content"), v), F.col("line"))).alias(f"t{i}") for i, v in enumerate(terms.values())))
    picked = F.slice(F.array_distinct(F.array_compact(F.array(*(f"t{i}" for i in range(len(terms)))))), 1, ANCHORS)
    return firsts.select("path", F.explode(picked).alias("line"))


def ranked_coverage(files: DataFrame, query: str) -> DataFrame:
    """Files of the strongest coverage in rank order: terms, path rank, content terms, span, path."""
    scored = coverage(files, query).persist()  # one pass over the texts; its rows are small
    best = scored.agg(F.max("matched").alias("_best"))
    top = scored.join(F.broadcast(best), F.col("matched") == F.col("_best")).drop("_best", "hits")
    spans = cohesive_windows(files.join(top.select("path"), "path", "left_semi"), query)
    return top.join(spans, "path", "left").orderBy(F.desc("matched"), "path_rank", F.desc("content_matched"), F.asc_nulls_last("span"), "path")


def decisive(files: DataFrame, query: str) -> list[str] | None:
    """Up to three paths that answer a query of two to eight terms whole, or None.

    They hold every term in content; either one path alone names every term too, or no file
    leans on its path for a term and at most three hold all; terms lie within 50 lines.
    """
    terms = text.query_terms(query)
    if not 2 <= len(terms) <= 8:
        return None
    n = len(terms)
    named = reduce(lambda a, b: a & b, [text.contains_any(F.lower("path"), v) for v in terms.values()])
    scored = coverage(files, query).withColumn("named", named)
    figures = scored.agg(
        F.count_if(F.col("content_matched") == n).alias("whole"),
        F.count_if((F.col("content_matched") == n) & F.col("named")).alias("aligned"),
        F.count_if((F.col("matched") == n) & (F.col("content_matched") < n)).alias("leaning"),
    ).first()
    whole = scored.where(F.col("content_matched") == n)
    if figures.aligned == 1:
        whole = whole.where("named")
    elif not (0 < figures.whole <= 3 and figures.leaning == 0):
        return None
    chosen = files.join(whole.select("path", "path_rank"), "path")
    spans = cohesive_windows(chosen, query).where(F.col("span") <= WINDOW_LINES).join(whole.select("path", "path_rank"), "path")
    found = [r.path for r in spans.orderBy("path_rank", "span", "path").limit(3).collect()]
    return found or None


def match_rank(path: Column, content: Column, query: str, definition: Column) -> Column:
    """Where a match ranks; lower is better: path, then deprecation, then definitions first."""
    return paths.relevance(path, text.search_terms(query)) + F.when(content.rlike(r"(?i)\bdeprecated\b"), 4).otherwise(0) - definition.cast("int")


def word_runs(value: Column, n: int) -> Column:
    """Hashes of the distinct runs of ``n`` words of a text, parted by single spaces."""

    def runs(words: Column) -> Column:
        last = F.size(words) - n
        return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))))

    return F.transform(F.array(F.split(value, " ")), runs)[0]  # bound by a lambda, so that a text is split once


def phrase_matches(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) that hold a phrase (item_id, phrase) as it is.

    A phrase of five words or more meets the documents that have its second to fourth word in a
    row, by the hash of these; a document's phrases are then looked for in one pass. Shorter
    ones are looked for directly, in one expression for each ``DIRECT`` of them.
    """
    cut = phrases.where("phrase <> ''").withColumn("_w", F.split("phrase", " "))
    long = cut.where(F.size("_w") >= 5).select("item_id", "phrase", F.xxhash64(*(F.col("_w")[k] for k in (1, 2, 3))).alias("_key"))
    met = documents.select("doc_id", F.explode(word_runs(F.col("text"), 3)).alias("_key")).join(small(long), "_key")
    wanted = met.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "phrase")).alias("_p"))
    held = F.filter("_p", lambda p: F.contains("text", p["phrase"]))
    found = documents.join(wanted, "doc_id").select("doc_id", F.explode(F.transform(held, lambda p: p["item_id"])).alias("item_id"))
    short = cut.where(F.size("_w") < 5).select("item_id", "phrase")
    parts = max(1, -(-short.count() // DIRECT))
    for part in range(parts):
        some = short.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # about DIRECT rows
        if some:
            flags = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(r.phrase)), F.lit(r.item_id)) for r in some)))
            found = found.unionByName(documents.select("doc_id", F.explode(flags).alias("item_id")))
    return found.distinct()
