"""Queries over document text: mentions, usage, text search, coverage, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import paths, text
from corpuscle.operators import search, stats
from corpuscle.plans.registry import query
from corpuscle.sources.tables import table

_FILES = "SELECT doc_id, source || '/' || lang || '/doc' || doc_id || '.md' AS path, text, lang, source FROM documents"
_LINES = "SELECT path, unnest(string_split_regex(text, '\\r?\\n')) AS content, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line FROM files"
_COMPACT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def files(spark, sf_dir):
    """Documents as files of source/lang/docN.md."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text", "lang", "source")


def mentions(files_):
    return files_.select(F.explode(F.regexp_extract_all("text", F.lit(text.IDENTIFIER), F.lit(0))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


_MENTIONS = r"t AS (SELECT unnest(regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9_]*\b')) AS name FROM documents), c AS (SELECT name, count(*) AS n FROM t GROUP BY name)"


@query("mentions_all", f"WITH {_MENTIONS} SELECT name, n FROM c")
def mentions_all(spark, sf_dir):
    """Mention counts of every identifier."""
    return mentions(table(spark, sf_dir, "documents"))


@query("mentions_top", f"WITH {_MENTIONS} SELECT name, n FROM c ORDER BY n DESC, name LIMIT 100")
def mentions_top(spark, sf_dir):
    """The 100 most mentioned identifiers."""
    return mentions(table(spark, sf_dir, "documents")).orderBy(F.desc("n"), "name").limit(100)


_BINS = """
x AS (SELECT {v} AS v FROM {t}),
e AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, bool_and(v = floor(v)) AS whole FROM x),
w AS (SELECT *, least(10, ceil(log2(n) + 1)) AS wanted, hi - lo + whole::INT AS span FROM e),
k AS (SELECT *, CASE WHEN lo = hi THEN 1.0 WHEN whole THEN ceil(span / wanted) ELSE span / wanted END AS width FROM w),
b AS (SELECT *, (CASE WHEN lo = hi THEN 1 WHEN whole THEN ceil(span / width) ELSE wanted END)::INT AS nb FROM k),
c AS (SELECT least(nb - 1, floor((v - lo) / width))::INT AS bin, count(*) AS n FROM x, b GROUP BY 1),
f AS (SELECT unnest(generate_series(0, nb - 1))::INT AS bin, lo, hi, width, nb, whole FROM b)
SELECT f.bin, (lo + f.bin * width)::DOUBLE AS low, (CASE WHEN f.bin = nb - 1 THEN hi ELSE lo + f.bin * width + width - whole::INT END)::DOUBLE AS high, coalesce(c.n, 0) AS n
FROM f LEFT JOIN c ON f.bin = c.bin
"""


@query("usage_bins", "WITH " + _MENTIONS + "," + _BINS.format(v="n::DOUBLE", t="c").replace("c AS (SELECT least", "cc AS (SELECT least").replace("LEFT JOIN c ON f.bin = c.bin", "LEFT JOIN cc c ON f.bin = c.bin"))
def usage_bins(spark, sf_dir):
    """Automatic bins of mention counts."""
    return stats.bins(mentions(table(spark, sf_dir, "documents")), "n")


@query("length_bins", "WITH " + _BINS.format(v="n_chars::DOUBLE", t="documents"))
def length_bins(spark, sf_dir):
    """Automatic bins of document lengths, whole numbers."""
    return stats.bins(table(spark, sf_dir, "documents"), "n_chars")


@query("price_bins", "WITH " + _BINS.format(v="o_totalprice::DOUBLE", t="orders"))
def price_bins(spark, sf_dir):
    """Automatic bins of order prices, fractions."""
    return stats.bins(table(spark, sf_dir, "orders"), "o_totalprice")


def _describe_sql(value, source, by=""):
    k = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return f"""SELECT {k}count(v) AS n, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, min(v) AS low, quantile_cont(v, 0.25) AS p25,
      quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, round(quantile_cont(v, 0.9), 6) AS p90, max(v) AS high FROM (SELECT {k}{value}::DOUBLE AS v FROM {source}){g}"""


def _described(df, value, by=None):
    return stats.describe(df, value, by).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "p90": F.round("p90", 6)})


@query("describe_lengths", _describe_sql("n_chars", "documents"))
def describe_lengths(spark, sf_dir):
    """Exact figures of document lengths."""
    return _described(table(spark, sf_dir, "documents"), "n_chars")


@query("describe_by_language", _describe_sql("n_chars", "documents", "lang"))
def describe_by_language(spark, sf_dir):
    """Exact figures of document lengths for each language."""
    return _described(table(spark, sf_dir, "documents"), "n_chars", ["lang"])


@query("describe_event_values", _describe_sql("value", "events", "event_type"))
def describe_event_values(spark, sf_dir):
    """Exact figures of event values for each type."""
    return _described(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("describe_quantities", _describe_sql("l_quantity", "lineitem", "l_returnflag"))
def describe_quantities(spark, sf_dir):
    """Exact figures of quantities after grouping."""
    return _described(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query(
    "text_search_literal",
    f"""WITH files AS ({_FILES}), l AS ({_LINES}), m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM l WHERE contains(lower(content), 'licensed'))
    SELECT path, line::INT AS line, (octet_length(encode(substr(content, 1, strpos(lower(content), 'licensed')::INT - 1))) + 1)::INT AS col,
      CASE WHEN length(t) > 240 THEN rtrim(substr(t, 1, 237)) || '...' ELSE t END AS text
    FROM (SELECT *, {_COMPACT.format('content')} AS t FROM m WHERE r <= 2)""",
)
def text_search_literal(spark, sf_dir):
    """Lines that hold a phrase, two of a file."""
    return search.literal_matches(files(spark, sf_dir), "Licensed")


@query("files_with_match", f"WITH files AS ({_FILES}) SELECT path FROM files WHERE contains(lower(text), 'ence') OR contains(lower(text), 'tions')")
def files_with_match(spark, sf_dir):
    """Files that hold any variant."""
    return search.files_with(files(spark, sf_dir), ["ence", "tions"])


_QUERY = "the licensed oration"  # stop words go; two terms stay
_COVER = f"""WITH files AS ({_FILES}), f AS (SELECT path, text, contains(lower(text), 'licensed') AS h0, contains(lower(text), 'oration') AS h1,
  contains(lower(path), 'licensed') AS p0, contains(lower(path), 'oration') AS p1,
  (4 + 5 - 2 * (contains(lower(path), 'licensed')::INT + contains(lower(path), 'oration')::INT)) AS path_rank FROM files)"""


@query("term_coverage", f"{_COVER} SELECT path, (h0 OR p0)::INT + (h1 OR p1)::INT AS matched, h0::INT + h1::INT AS content_matched, path_rank FROM f WHERE h0 OR h1")
def term_coverage(spark, sf_dir):
    """How many terms of a query each file holds."""
    return search.coverage(files(spark, sf_dir), _QUERY).drop("hits")


_WINDOWS = """WITH files AS (%s), smr AS (SELECT path, text, contains(lower(text), 'and') AS h0, contains(lower(text), 'ding') AS h1, contains(lower(text), 'tionly') AS h2 FROM files),
two AS (SELECT * FROM smr WHERE h0::INT + h1::INT + h2::INT >= 2),
l AS (SELECT path, h0, h1, h2, unnest(string_split_regex(text, '\\r?\\n')) AS content, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line FROM two),
t AS (SELECT *, contains(lower(content), 'and') AS t0, contains(lower(content), 'ding') AS t1, contains(lower(content), 'tionly') AS t2 FROM l),
s AS (SELECT *, CASE WHEN h0 THEN coalesce(max(CASE WHEN t0 THEN line END) OVER w, 0) END AS l0, CASE WHEN h1 THEN coalesce(max(CASE WHEN t1 THEN line END) OVER w, 0) END AS l1,
  CASE WHEN h2 THEN coalesce(max(CASE WHEN t2 THEN line END) OVER w, 0) END AS l2, coalesce(max(CASE WHEN t0::INT + t1::INT + t2::INT >= 2 THEN line END) OVER w, 0) AS d
  FROM t WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT path, list_min([l0, l1, l2, d]) AS s, line AS e FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY e - s, e) AS k FROM v WHERE s > 0), best AS (SELECT path, s, e FROM r WHERE k = 1)
""" % _FILES
_THREE = "anding dings tionly"


def _three(spark, sf_dir):
    return files(spark, sf_dir)


@query("cohesion_window", _WINDOWS.replace("'and'", "'anding'") + "SELECT path, s::INT AS start, e::INT AS \"end\", (e - s + 1)::INT AS span FROM best")
def cohesion_window(spark, sf_dir):
    """Narrowest lines that hold all of a file's terms."""
    return search.cohesive_windows(_three(spark, sf_dir), _THREE)


@query(
    "anchors",
    _WINDOWS.replace("'and'", "'anding'")
    + """, a AS (SELECT t.path, min(CASE WHEN t0 THEN line END) AS a0, min(CASE WHEN t1 THEN line END) AS a1, min(CASE WHEN t2 THEN line END) AS a2
      FROM t JOIN best ON t.path = best.path AND line BETWEEN s AND e GROUP BY t.path),
    o AS (SELECT path, unnest([a0, a1, a2]) AS line, unnest([0, 1, 2]) AS k FROM a), u AS (SELECT path, line, min(k) AS k FROM o WHERE line IS NOT NULL GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k) AS r FROM u) SELECT path, line::INT AS line FROM n WHERE r <= 2""",
)
def anchors(spark, sf_dir):
    """First lines of the terms inside the window."""
    f = _three(spark, sf_dir)
    return search.anchors(f, search.cohesive_windows(f, _THREE), _THREE)


@query(
    "ranked_coverage",
    _WINDOWS.replace("'and'", "'anding'")
    + """, c AS (SELECT path, h0::INT + h1::INT + h2::INT AS m FROM smr) SELECT c.path, m AS matched, m AS content_matched, 9 AS path_rank, s::INT AS start, e::INT AS "end", (e - s + 1)::INT AS span
      FROM c LEFT JOIN best ON c.path = best.path WHERE m = (SELECT max(m) FROM c) AND m > 0""",
)
def ranked_coverage(spark, sf_dir):
    """Files of the strongest coverage with their windows."""
    return search.ranked_coverage(_three(spark, sf_dir), _THREE)


_URL = "regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1)"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1).alias("path"), "url")


@query(
    "path_policy",
    f"""WITH p AS (SELECT page_id, {_URL} AS path FROM pages), n AS (SELECT *, list_filter(string_split_regex(lower(path), '[\\\\/]+'), lambda x: x <> '') AS parts FROM p)
    SELECT page_id, path, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT AS depth,
      (len(list_filter(parts, lambda x: x IN ('__specs__','__test__','__tests__','e2e','spec','specs','test','test-support','test_support','tests') OR regexp_matches(x, '^test[-_]|[-_]tests?$'))) > 0
       OR coalesce(starts_with(parts[-1], 'test_') OR regexp_matches(parts[-1], '[_.]test[.-]|[_.]spec\\.|[_.]suite\\.'), false)) AS is_test,
      CASE WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 'docs' WHEN regexp_matches(lower(path), '\\.(json|toml|yaml|yml)$') THEN 'config'
        WHEN regexp_matches(lower(path), '^(\\.github|deploy|infra|infrastructure)/') THEN 'infra' WHEN regexp_matches(lower(path), '\\.(csv|db|parquet|proto|graphql|prisma|sql)$') THEN 'data' ELSE 'code' END AS category
    FROM n""",
)
def path_policy(spark, sf_dir):
    """Depth, test flag and category of each page's path."""
    p = F.col("path")
    return _paths(spark, sf_dir).select("page_id", "path", paths.depth(p).alias("depth"), F.coalesce(paths.is_test(p), F.lit(False)).alias("is_test"), paths.category(p).alias("category"))


@query("path_exactness", f"""WITH p AS (SELECT {_URL} AS path FROM pages), e AS (SELECT path, CASE WHEN lower(path) = 'en' THEN 0 WHEN ends_with(lower(path), '/en') THEN 1 WHEN contains(lower(path), 'en') THEN 2 END AS exactness FROM p)
    SELECT path, exactness FROM e WHERE exactness IS NOT NULL""")
def path_exactness(spark, sf_dir):
    """Paths that match a query, the more exact first."""
    return search.path_matches(_paths(spark, sf_dir), "en")


@query("ancestor_counts", f"""WITH p AS (SELECT string_split({_URL}, '/') AS s FROM pages), a AS (SELECT array_to_string(s[1:i], '/') AS prefix FROM p, generate_series(1, 20) g(i) WHERE i < len(s))
    SELECT prefix, count(*) AS n FROM a WHERE prefix <> '' GROUP BY prefix""")
def ancestor_counts(spark, sf_dir):
    """Pages below each ancestor directory."""
    return stats.ancestor_counts(_paths(spark, sf_dir), paths.ancestors(F.col("path")))


@query("glob_filter", f"WITH p AS (SELECT page_id, {_URL} AS path FROM pages) SELECT page_id, path FROM p WHERE regexp_full_match(path, 'en/.*\\.html')")
def glob_filter(spark, sf_dir):
    """Paths that match a glob whole."""
    return _paths(spark, sf_dir).where(text.glob_filter(F.col("path"), "en/*.html")).select("page_id", "path")


@query("language_shares", "SELECT lang, sum(n_chars)::BIGINT AS weight, sum(n_chars) / (SELECT sum(n_chars) FROM documents) AS share FROM documents GROUP BY lang")
def language_shares(spark, sf_dir):
    """Each language's part of all characters."""
    return stats.shares(table(spark, sf_dir, "documents"), "lang", F.col("n_chars"))


@query("ordered_distinct", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def ordered_distinct(spark, sf_dir):
    """Sources in the order they are first seen."""
    return stats.ordered_distinct(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("except_labelled", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_labelled(spark, sf_dir):
    """Documents without a label."""
    return stats.unseen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("intersect_labelled", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def intersect_labelled(spark, sf_dir):
    """Documents with a toxic label."""
    return stats.in_all(["doc_id"], table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"))


@query("merged_rows", "SELECT doc_id, quality, 1 AS lane FROM labels UNION ALL SELECT d.doc_id, NULL, 2 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def merged_rows(spark, sf_dir):
    """Labelled rows first, then documents that no label names."""
    from corpuscle.operators import surfaces

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return surfaces.merged_metrics(labels, table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("line_counts", f"""WITH files AS ({_FILES}) SELECT path, (CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END)::INT AS n_lines FROM files""")
def line_counts(spark, sf_dir):
    """Lines of each file; a newline at the end begins none."""
    return files(spark, sf_dir).select("path", search.line_count(F.col("text")).alias("n_lines"))


@query("first_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2")
def first_turns(spark, sf_dir):
    """The first two turns of each conversation."""
    return stats.first_n_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], 2).select("conv_id", "turn", "role")


@query("benchmark_phrases", f"""WITH files AS ({_FILES}), b AS (SELECT item_id, lower(string_split(text, '.')[1]) AS phrase FROM benchmark)
    SELECT item_id, count(*) AS n FROM b, files WHERE phrase <> '' AND contains(lower(files.text), phrase) GROUP BY item_id""")
def benchmark_phrases(spark, sf_dir):
    """Documents that hold the first sentence of each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.substring_index("text", ".", 1)).alias("phrase"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return search.phrase_matches(docs, items).groupBy("item_id").agg(F.count("*").alias("n"))
