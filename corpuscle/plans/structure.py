"""Definitions, profiles, surfaces and bounded answers over the harness tables.

Paths, names and lines are made from keys by the same rule in the query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import bounded, definitions, overview, profiles
from corpuscle.plans.registry import query
from corpuscle.plans.syntax import written
from corpuscle.sources.tables import table

_SUFFIX = "CASE p_partkey % 7 WHEN 0 THEN '.go' WHEN 1 THEN '.rs' WHEN 2 THEN '.py' WHEN 3 THEN '.ts' WHEN 4 THEN '' WHEN 5 THEN '.rb' ELSE '.zig' END"
_FOLDER = "CASE p_partkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/core/' WHEN 2 THEN 'src/' WHEN 3 THEN '' ELSE 'generated/' END"
_PATH = f"{_FOLDER} || 'p' || p_partkey || {_SUFFIX}"
_DOCS = "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text FROM documents"


def part_paths(spark, sf_dir):
    """A path of some language in some directory for each part."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATH).alias("path"))


def document_files(spark, sf_dir):
    """Each document as a file below its source and language, with its number of lines."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"), F.size(F.split("text", "\n")).alias("n_lines"), F.octet_length("text").alias("n_bytes"))


@query("definition_lanes", """WITH a AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem WHERE l_quantity >= 40)
  SELECT path, line, 'syntax' AS lane FROM a UNION ALL SELECT path, line, 'pattern' FROM b ANTI JOIN a USING (path, line)""")
def definition_lanes(spark, sf_dir):
    """Places of a first lane, and those of a second that the first lacks."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_quantity")
    return definitions.union_without(rows.where("l_returnflag = 'R'").select("path", "line"), rows.where("l_quantity >= 40").select("path", "line"), ["path", "line"])


@query(
    "symbol_definitions",
    """SELECT 'n' || n_nationkey || '/util.py' AS path, 4 AS line, 5 AS col, 'helper' AS symbol, 'syntax' AS lane FROM nation
    UNION ALL SELECT 'web/s' || s_suppkey || '/area.ts', 2, 14, 'area', 'syntax' FROM supplier""",
)
def symbol_definitions(spark, sf_dir):
    """Where two names are defined, callables only."""
    rows = definitions.symbol_definitions(written(spark, sf_dir, "files"), written(spark, sf_dir, "facts"), ["helper", "area"], callable_only=True)
    return rows.select("path", "line", "col", "symbol", "lane")


@query("unscanned_languages", f"""WITH p AS (SELECT {_SUFFIX} AS s FROM part) SELECT DISTINCT CASE s WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.rb' THEN 'ruby' WHEN '' THEN 'unsuffixed files' ELSE 'zig' END AS language FROM p WHERE s NOT IN ('.py', '.ts')""")
def unscanned_languages(spark, sf_dir):
    """Languages of files that no scanner parses."""
    return definitions.unscanned_languages(part_paths(spark, sf_dir))


@query("unparsed_definitions", f"""WITH g AS (SELECT p_partkey AS k, {_PATH} AS path FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 IN (1, 2, 3))
  SELECT 'Function' AS label, 'run' || k AS name, path AS file_path, 2 AS start_line, 4 AS end_line FROM g UNION ALL SELECT 'Class', 'Options' || k, path, 5, 6 FROM g""")
def unparsed_definitions(spark, sf_dir):
    """Functions and types of languages without a scanner, by their keywords."""
    k = F.col("p_partkey").cast("string")
    source = F.concat(F.lit("package main\nfunc (s *S) run"), k, F.lit("() {\n  return 1\n}\nstruct Options"), k, F.lit(" {\n}\n"))
    files = part_paths(spark, sf_dir).where("p_partkey % 7 = 0").select("path", source.alias("text"))
    return definitions.unparsed_definitions(files)


_FOREIGN = f"""d AS (SELECT CASE l_returnflag WHEN 'A' THEN 'Method' WHEN 'N' THEN 'Struct' ELSE 'Function' END AS label, 'n' || l_orderkey AS name, l_partkey AS p_partkey, l_linenumber - 1 AS start_line, l_linenumber + l_suppkey % 9 AS end_line FROM lineitem)"""


def foreign_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr("CASE l_returnflag WHEN 'A' THEN 'Method' WHEN 'N' THEN 'Struct' ELSE 'Function' END").alias("label"), F.concat(F.lit("n"), "l_orderkey").alias("name"),
        F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") - 1).cast("int").alias("start_line"), (F.col("l_linenumber") + F.col("l_suppkey") % 9).cast("int").alias("end_line"))
    return rows.withColumn("file_path", F.expr(_PATH)).drop("p_partkey")


@query("foreign_definitions", f"""WITH {_FOREIGN}, f AS (SELECT p_partkey, {_PATH} AS file_path FROM part WHERE p_partkey % 3 <> 0)
  SELECT label, name, file_path, start_line::INT AS start_line, (end_line - start_line + 1)::INT AS span FROM d JOIN f USING (p_partkey) WHERE start_line >= 1 AND p_partkey % 7 NOT IN (2, 3) AND p_partkey % 5 IN (1, 2, 3)""")
def foreign_definitions(spark, sf_dir):
    """Definitions from elsewhere that count: placed, in production code that exists and no scanner parses."""
    return definitions.eligible_definitions(foreign_rows(spark, sf_dir), part_paths(spark, sf_dir).where("p_partkey % 3 <> 0"))


@query("counted_languages", f"""WITH {_FOREIGN}, own AS (SELECT p_partkey, max((label IN ('Function', 'Method'))::INT) AS calls FROM d GROUP BY 1), s AS (SELECT {_SUFFIX} AS suffix, sum(p_size)::BIGINT AS n_bytes FROM own JOIN part USING (p_partkey) WHERE p_partkey % 7 <> 6 OR p_partkey < 30 GROUP BY 1 HAVING max(calls) = 1)
  SELECT suffix, n_bytes FROM s WHERE n_bytes >= 0.01 * (SELECT sum(n_bytes) + 5000 FROM s)""")
def counted_languages(spark, sf_dir):
    """Languages with a function and a hundredth of all bytes."""
    rows = foreign_rows(spark, sf_dir)
    files = table(spark, sf_dir, "part").where("p_partkey % 7 <> 6 OR p_partkey < 30").select(F.expr(_PATH).alias("path"), F.col("p_size").cast("long").alias("n_bytes"))
    return definitions.counted_languages(rows, files, spark.createDataFrame([(5000,)], "n_bytes long"))


@query("test_like_rows", """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'testParser' WHEN 1 THEN 'testament' WHEN 2 THEN 'run_test' WHEN 3 THEN 'latest' ELSE 'plain' END AS name, CASE event_id % 4 WHEN 0 THEN 'src/app.spec.ts' WHEN 1 THEN 'src/tests/a.py' ELSE 'src/a.py' END AS path FROM events)
  SELECT event_id FROM r WHERE event_id % 6 = 0 OR event_id % 4 IN (0, 1)""")
def test_like_rows(spark, sf_dir):
    """Rows whose name or path reads like a test."""
    name = F.expr("CASE event_id % 6 WHEN 0 THEN 'testParser' WHEN 1 THEN 'testament' WHEN 2 THEN 'run_test' WHEN 3 THEN 'latest' ELSE 'plain' END")
    path = F.expr("CASE event_id % 4 WHEN 0 THEN 'src/app.spec.ts' WHEN 1 THEN 'src/tests/a.py' ELSE 'src/a.py' END")
    return table(spark, sf_dir, "events").where(definitions.test_like(name, path)).select("event_id")


@query("directory_profile", "SELECT count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS defines, sum(n_chars)::BIGINT AS imports_local FROM documents WHERE source = 'src1' AND text IS NOT NULL")
def directory_profile(spark, sf_dir):
    """Sums over the files of a directory."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat_ws("/", "source", "lang", "doc_id").alias("file"), F.size(F.split("text", "\n")).alias("defines"), F.col("n_chars").alias("imports_local"))
    return profiles.directory_profile(rows, "src1")


@query("largest_files", f"WITH f AS ({_DOCS} WHERE text IS NOT NULL) SELECT path, len(string_split(text, chr(10)))::INT AS n_lines, 'txt' AS language, 'docs' AS category FROM f WHERE path LIKE 'src2/%' ORDER BY n_lines DESC, path LIMIT 12")
def largest_files(spark, sf_dir):
    """The longest files of a directory."""
    from corpuscle.functions import paths

    files = document_files(spark, sf_dir)
    return profiles.largest_files(files.select("path", "n_lines", paths.language(F.col("path")).alias("language"), paths.category(F.col("path")).alias("category")), "src2", 12)


@query("dense_files", "SELECT 'n' || c_nationkey || '/c' || c_custkey AS file, c_custkey % 97 AS total FROM customer WHERE c_nationkey = 3 ORDER BY total DESC, file LIMIT 10")
def dense_files(spark, sf_dir):
    """The fullest files of a directory, ties by path."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey", F.lit("/c"), "c_custkey").alias("file"), (F.col("c_custkey") % 97).alias("total"))
    return profiles.dense_files(rows, "n3", 10)


@query("variable_profile", """SELECT 'f' || l_orderkey || '::v' || l_linenumber AS identifier, l_suppkey AS line, l_linestatus AS scope, 'f' || l_orderkey AS file, o_totalprice AS total FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'O' WHERE l_linenumber = 6""")
def variable_profile(spark, sf_dir):
    """Definitions of one variable, each with its file's profile."""
    f = F.concat(F.lit("f"), "l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(f.alias("file"), F.concat(F.lit("v"), "l_linenumber").alias("name"), F.concat(f, F.lit("::v"), "l_linenumber").alias("identifier"), F.col("l_suppkey").alias("line"), F.col("l_linestatus").alias("scope"))
    files = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("f"), "o_orderkey").alias("file"), F.col("o_totalprice").alias("total"))
    return profiles.variable_profile(rows, files, "v6")


@query("filled_lengths", f"WITH f AS ({_DOCS} WHERE text IS NOT NULL) SELECT path AS file, len(string_split(text, chr(10)))::INT AS lines FROM f")
def filled_lengths(spark, sf_dir):
    """Lengths of zero taken from the inventory."""
    files = document_files(spark, sf_dir)
    return profiles.filled_lengths(files.select(F.col("path").alias("file"), F.when(F.length("path") % 2 == 0, F.col("n_lines")).otherwise(0).alias("lines")), files)


_EVENT_DOCS = "d AS (SELECT user_id % 300 AS path, event_type AS name, CASE WHEN event_id % 3 = 0 THEN 'class' WHEN event_id % 3 = 1 THEN 'method' ELSE 'function' END AS kind, event_id AS line, CASE WHEN event_id % 4 > 0 THEN 'Doc ' || event_id || '. More.' END AS docstring FROM events)"


def event_docs(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 300 AS path", "event_type AS name", "event_type AS qualified_name", "CASE WHEN event_id % 3 = 0 THEN 'class' WHEN event_id % 3 = 1 THEN 'method' ELSE 'function' END AS kind",
        "event_id AS line", "CASE WHEN event_id % 4 > 0 THEN concat('Doc ', event_id, '. More.') END AS docstring", "CAST(NULL AS STRING) AS parse_error")


@query("symbol_docstrings", f"""WITH {_EVENT_DOCS}, w AS (SELECT DISTINCT path, name FROM d) SELECT w.path, w.name, min_by(docstring, (kind = 'method', line)) AS docstring FROM w LEFT JOIN d ON d.path = w.path AND d.name = w.name AND kind <> 'class' AND docstring IS NOT NULL GROUP BY ALL""")
def symbol_docstrings(spark, sf_dir):
    """Documentation of a function by name: functions before methods, the earliest first."""
    docs = event_docs(spark, sf_dir)
    wanted = docs.select("path", "name", F.lit("function").alias("kind"), F.lit(0).alias("line")).distinct()
    return profiles.symbol_docstrings(docs, wanted).select("path", "name", "docstring")


@query("symbol_descriptions", f"""WITH {_EVENT_DOCS}, w AS (SELECT DISTINCT path, name FROM d),
  f AS (SELECT path, name, min_by(docstring, (kind = 'method', line)) AS t FROM d WHERE kind <> 'class' AND docstring IS NOT NULL GROUP BY ALL), c AS (SELECT path, name, min_by(docstring, line) AS t FROM d WHERE kind = 'class' AND docstring IS NOT NULL GROUP BY ALL)
  SELECT w.path, w.name, regexp_extract(coalesce(f.t, c.t), '^(.*?[.])', 1) AS description FROM w LEFT JOIN f USING (path, name) LEFT JOIN c USING (path, name) WHERE coalesce(f.t, c.t) IS NOT NULL""")
def symbol_descriptions(spark, sf_dir):
    """First sentences: of the function, else of the class, else of the file."""
    docs = event_docs(spark, sf_dir)
    symbols = docs.select("path", "name", F.lit(0).alias("line")).distinct()
    return profiles.descriptions(docs, symbols).where("description IS NOT NULL").select("path", "name", "description")


@query("likely_mains", """WITH d AS (SELECT 'f' || l_suppkey AS path, CASE l_linenumber WHEN 1 THEN 'main' WHEN 2 THEN 'build_it' WHEN 3 THEN '_x' WHEN 4 THEN '__init__' ELSE 'other' END AS name, l_orderkey AS line, l_returnflag = 'R' AS doc FROM lineitem),
  p AS (SELECT *, path || '.' || name || line AS q, (NOT doc)::INT AS a, (name = '__init__')::INT AS b, CASE name WHEN 'main' THEN 0 WHEN 'build_it' THEN 1 WHEN 'other' THEN 2 ELSE 3 END AS c FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY a, b, c, line, path, q) AS r FROM p), s AS (SELECT path FROM r WHERE r = 1 ORDER BY a, b, c, line, path, q LIMIT 3)
  SELECT path, q AS qualified_name, line FROM r WHERE r <= 6 AND path IN (SELECT path FROM s) ORDER BY a, b, c, line, path, q LIMIT 6""")
def likely_mains(spark, sf_dir):
    """Functions to name first, of three files at most."""
    name = F.expr("CASE l_linenumber WHEN 1 THEN 'main' WHEN 2 THEN 'build_it' WHEN 3 THEN '_x' WHEN 4 THEN '__init__' ELSE 'other' END")
    docs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), "l_suppkey").alias("path"), name.alias("name"), F.col("l_orderkey").alias("line"), F.lit("function").alias("kind"), F.when(F.col("l_returnflag") == "R", "d").alias("docstring"))
    return profiles.likely_mains(docs.withColumn("qualified_name", F.concat("path", F.lit("."), "name", "line")))


@query("documentation_focus", f"""WITH {_EVENT_DOCS}, p AS (SELECT DISTINCT path FROM d), top AS (SELECT path FROM p ORDER BY path % 41 DESC, path LIMIT 3) SELECT path, kind, count(*) AS total, count(docstring) AS present FROM d WHERE path IN (SELECT path FROM top) GROUP BY ALL""")
def documentation_focus(spark, sf_dir):
    """Documentation of the files of highest score."""
    docs = event_docs(spark, sf_dir)
    scores = docs.select(F.col("path").alias("file"), (F.col("path") % 41).alias("score")).distinct()
    return profiles.documentation_focus(docs, scores)


@query("symbols_by_name", """WITH s AS (SELECT 'n' || l_partkey % 50 AS name, l_suppkey AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R'), x AS (SELECT DISTINCT 'n' || l_partkey % 50 AS name, l_suppkey AS path FROM lineitem WHERE l_returnflag = 'A')
  SELECT name, path, line FROM s UNION ALL SELECT name, path, 0 FROM x ANTI JOIN (SELECT DISTINCT name, path FROM s) USING (name, path)""")
def symbols_by_name(spark, sf_dir):
    """Function spans, then exported names without a span in their file."""
    kind = F.when(F.col("l_returnflag") == "R", "function").when(F.col("l_returnflag") == "A", "export")
    rows = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.concat(F.lit("n"), F.col("l_partkey") % 50).alias("name"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line"))
    return profiles.symbols_by_name(rows)


@query("most_called_share", """WITH c AS (SELECT CASE l_suppkey % 5 WHEN 0 THEN 'a.get' WHEN 1 THEN '#hash' WHEN 2 THEN 'run (x)' ELSE 'm.s' || l_suppkey END AS target FROM lineitem)
  SELECT target, count(*) AS calls, count(*) / (SELECT count(*) FROM c) AS share FROM c WHERE target LIKE 'm.%' GROUP BY target""")
def most_called_share(spark, sf_dir):
    """Symbols by their part of all calls; generic names go."""
    target = F.expr("CASE l_suppkey % 5 WHEN 0 THEN 'a.get' WHEN 1 THEN '#hash' WHEN 2 THEN 'run (x)' ELSE concat('m.s', l_suppkey) END")
    return overview.most_called(table(spark, sf_dir, "lineitem").select(target.alias("target")))


@query("cluster_labels", """WITH g AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), m AS (SELECT c_nationkey AS k, count(*) AS members FROM customer GROUP BY 1), x AS (SELECT k, members, CASE k % 4 WHEN 0 THEN 'src/r' || r WHEN 1 THEN 'area' || r WHEN 2 THEN 'first' || k ELSE 'src' END AS label, 'first' || k AS anchor FROM g JOIN m USING (k)),
  y AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM x) SELECT k AS cluster, CASE WHEN n > 1 OR label = 'src' THEN label || ' — ' || anchor ELSE label END AS label, members / (SELECT least(8000, sum(members)) FROM m) AS share FROM y""")
def cluster_labels(spark, sf_dir):
    """Labels of clusters: the owner of their files, else their own, else a name; repeated ones get a suffix."""
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("members"))
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    kind = F.col("n_nationkey") % 4
    label = F.when(kind == 1, F.concat(F.lit("area"), r)).when(kind == 2, "work-corpus").when(kind == 3, "src")
    owned = F.array(F.concat(F.lit("src/r"), r, F.lit("/x/a.py")), F.concat(F.lit("src/r"), r, F.lit("/y/b.py")))
    files = F.when(kind == 0, owned).otherwise(F.array(F.lit("src/a.py"), F.lit("lib/b.py")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster"), label.alias("label"), F.array(F.lit("get"), F.concat(F.lit("first"), k)).alias("names"), files.alias("files"))
    return overview.cluster_labels(rows.join(sizes, "cluster"), "/home/work/corpus")


@query("export_groups", """WITH e AS (SELECT o_custkey % 40 AS file, l_suppkey % 6 AS origin, 'n' || l_partkey % 30 AS name, min(l_orderkey * 10 + l_linenumber) AS ord FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
  SELECT file, origin, string_agg(name, ',' ORDER BY ord, name) AS names, min(ord)::BIGINT AS first FROM e GROUP BY ALL""")
def export_groups(spark, sf_dir):
    """Names by the module that defines them, as first seen."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select((F.col("o_custkey") % 40).alias("file"), (F.col("l_suppkey") % 6).alias("origin"), F.concat(F.lit("n"), F.col("l_partkey") % 30).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return overview.export_groups(rows).withColumn("names", F.array_join("names", ","))


@query("surface_winners", """WITH c AS (SELECT 's' || s_nationkey || '/' || CASE WHEN s_suppkey % 3 = 0 THEN 'm' || s_suppkey % 4 || '/' ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN 'index.ts' ELSE s_suppkey || '.ts' END AS file, s_suppkey AS k FROM supplier),
  d AS (SELECT file, max((k % 2 = 0)::INT) = 1 AS declared, max(k % 7) AS fan_in, max(k % 4) AS origins, max(k % 9) AS names FROM c GROUP BY file), f AS (SELECT n_nationkey AS ord, 's' || n_nationkey AS focus FROM nation),
  s AS (SELECT *, len(string_split(file, '/')) - 1 AS below, len(string_split(file, '/')) AS deep, NOT regexp_matches(file, '(^|/)index\\.[^./]+$') AS plain FROM d JOIN f ON starts_with(file, focus || '/')),
  r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY below, plain, NOT declared, file) AS e, row_number() OVER (PARTITION BY ord ORDER BY fan_in DESC, NOT declared, deep, file) AS c, below <= min(below) OVER (PARTITION BY ord) + 1 AS near FROM s),
  b AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY near DESC, origins DESC, names DESC, NOT declared, deep, file) AS b FROM r)
  SELECT file, ord, CASE WHEN e = 1 THEN 0 WHEN c = 1 AND fan_in > 0 THEN 1 ELSE 2 END::INT AS kind FROM b WHERE e = 1 OR c = 1 AND fan_in > 0 OR b = 1""")
def surface_winners(spark, sf_dir):
    """The entry, central and broad surface of each focus directory."""
    k = F.col("s_suppkey")
    folder = F.when(k % 3 == 0, F.concat(F.lit("m"), k % 4, F.lit("/"))).otherwise("")
    name = F.when(k % 5 == 0, "index.ts").otherwise(F.concat(k, F.lit(".ts")))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_nationkey", F.lit("/"), folder, name).alias("file"), k.alias("k"))
    candidates = rows.groupBy("file").agg((F.max((F.col("k") % 2 == 0).cast("int")) == 1).alias("declared"), F.max(F.col("k") % 7).alias("fan_in"), F.max(F.col("k") % 4).alias("origins"), F.max(F.col("k") % 9).alias("names"))
    focus = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("s"), "n_nationkey").alias("focus"))
    return overview.surface_winners(candidates, focus)


@query("sampled_roots", """WITH g AS (SELECT 'n' || c_nationkey AS parent, list('n' || c_nationkey || '/c' || c_custkey ORDER BY 'n' || c_nationkey || '/c' || c_custkey) AS l FROM customer GROUP BY 1)
  SELECT unnest(CASE WHEN len(l) <= 3 THEN l ELSE list_distinct([l[1], l[(len(l) - 1) // 2 + 1], l[len(l)]]) END) AS root FROM g UNION ALL SELECT ''""")
def sampled_roots(spark, sf_dir):
    """First, middle and last package of each family, and the one at the top."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey", F.lit("/c"), "c_custkey").alias("root"))
    return overview.sampled_roots(rows.unionByName(spark.createDataFrame([("",)], "root string")))


@query("compacted_references", """WITH e AS (SELECT DISTINCT s_nationkey AS node, CASE WHEN s_suppkey % 3 > 0 THEN 'packages/core/' ELSE 'apps/' END || 'x' || s_suppkey AS other FROM supplier),
  p AS (SELECT node, other, regexp_replace(other, '/[^/]*$', '') AS parent FROM e), z AS (SELECT node, parent, count(*) AS n, sum(count(*)) OVER (PARTITION BY node) AS t FROM p GROUP BY node, parent), b AS (SELECT node, parent FROM z WHERE n > 3 AND 2 * n > t AND parent LIKE '%/%')
  SELECT p.node, CASE WHEN b.parent IS NOT NULL THEN p.parent || '/*' ELSE other END AS label, CASE WHEN any_value(b.parent) IS NOT NULL THEN count(*) END AS n FROM p LEFT JOIN b ON p.node = b.node AND p.parent = b.parent GROUP BY 1, 2""")
def compacted_references(spark, sf_dir):
    """Related boundaries, a family of siblings as one."""
    k = F.col("s_suppkey")
    edges = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node"), F.concat(F.when(k % 3 > 0, "packages/core/").otherwise("apps/"), F.lit("x"), k).alias("other"))
    return overview.compacted_references(edges, "target").drop("examples")


@query("package_edges", """WITH p AS (SELECT s_suppkey AS root, 'Pkg_' || s_suppkey || '.core' AS name FROM supplier), d AS (SELECT DISTINCT l_suppkey AS root, 'pkg-' || (l_partkey % 40) || '-core' AS dependency FROM lineitem)
  SELECT d.root AS source, p.root AS target, 1::BIGINT AS weight FROM d JOIN p ON lower(regexp_replace(p.name, '[_.]+', '-', 'g')) = d.dependency WHERE d.root <> p.root""")
def package_edges(spark, sf_dir):
    """Packages that name one another in their manifests, however the names are spelt."""
    packages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("root"), F.concat(F.lit("Pkg_"), "s_suppkey", F.lit(".core")).alias("name"))
    needs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("root"), F.concat(F.lit("pkg-"), F.col("l_partkey") % 40, F.lit("-core")).alias("dependency")).distinct()
    return overview.package_edges(packages, needs)


@query("added_weights", """WITH u AS (SELECT l_suppkey AS source, l_partkey % 20 AS target, l_linenumber::BIGINT AS weight FROM lineitem UNION ALL SELECT s_suppkey, s_nationkey, 5 FROM supplier) SELECT source, target, sum(weight)::BIGINT AS weight FROM u GROUP BY ALL""")
def added_weights(spark, sf_dir):
    """Two relations as one, weights of a pair added."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 20).alias("target"), F.col("l_linenumber").cast("long").alias("weight"))
    return overview.added_weights(lines, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target"), F.lit(5).cast("long").alias("weight")))


@query("leading_tiers", """WITH c AS (SELECT 'p' || p_partkey AS path, p_size % 11 AS a, p_partkey % 3 AS b FROM part), z AS (SELECT a, b, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z),
  k AS (SELECT path, a, b, before, before + n > 60 AS cut, row_number() OVER (PARTITION BY a, b ORDER BY path) AS r FROM c JOIN t USING (a, b) WHERE before < 20 AND before < 60) SELECT path, a, b, (SELECT max(cut) FROM k) AS bounded FROM k WHERE before + r <= 60""")
def leading_tiers(spark, sf_dir):
    """The best tiers, as many as twenty answers need, sixty rows at most."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), (F.col("p_size") % 11).alias("a"), (F.col("p_partkey") % 3).alias("b"))
    return bounded.leading_tiers(rows, ["a", "b"], 20, 60)


@query("bounded_scan", f"""WITH i AS (SELECT {_PATH} AS path, p_size AS n_lines FROM part WHERE p_partkey % 7 IN (2, 3) AND p_partkey % 5 IN (1, 2, 3))
  SELECT path, n_lines, (SELECT count(*) FROM i) AS eligible, least(25, (SELECT count(*) FROM i))::BIGINT AS parsed FROM i ORDER BY n_lines DESC, path LIMIT 25""")
def bounded_scan(spark, sf_dir):
    """The longest files that a bounded scan reads, and its coverage."""
    from corpuscle.functions import paths

    p = F.col("path")
    rows = table(spark, sf_dir, "part").select(F.expr(_PATH).alias("path"), F.col("p_size").alias("n_lines"))
    return bounded.largest(bounded.is_light(rows.withColumn("language", paths.language(p)).withColumn("category", paths.category(p))), 25)
