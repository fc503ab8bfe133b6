"""Path policies, filters, file roles and module rankings over the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import paths, text
from corpuscle.operators import facts, payload, search, surfaces
from corpuscle.plans.registry import query
from corpuscle.plans.structure import _PATH, event_docs, part_paths
from corpuscle.sources import files as file_source
from corpuscle.sources.tables import table


@query("path_policies", f"""SELECT {_PATH} AS path, p_partkey % 5 = 4 AS generated, p_partkey % 5 = 0 AS test, false AS ignored, p_partkey % 7 IN (2, 3) AS supported,
  p_partkey % 7 IN (0, 1, 2, 3, 5) AND p_partkey % 5 <> 4 AS implementation, p_partkey % 7 IN (0, 1, 2, 3, 5) AS scanned FROM part""")
def path_policies(spark, sf_dir):
    """What each path counts as."""
    p = F.col("path")
    return part_paths(spark, sf_dir).select(
        "path", paths.is_generated(p).alias("generated"), paths.is_test(p).alias("test"), paths.is_ignored(p).alias("ignored"), paths.is_supported(p).alias("supported"),
        paths.is_implementation(p).alias("implementation"), paths.is_scanned(p).alias("scanned"))


@query("ignored_paths", """WITH p AS (SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'node_modules/x' || s_suppkey || '.py' WHEN 1 THEN '.hidden/a' || s_suppkey || '.ts' WHEN 2 THEN '.github/b' || s_suppkey || '.ts' WHEN 3 THEN 'target/c' || s_suppkey || '.ts' WHEN 4 THEN 'src/target/d' || s_suppkey || '.ts' ELSE 'src/e' || s_suppkey || '.ts' END AS path FROM supplier) SELECT path FROM p WHERE k % 6 IN (0, 1, 3)""")
def ignored_paths(spark, sf_dir):
    """Paths below directories that never count."""
    path = F.expr("CASE s_suppkey % 6 WHEN 0 THEN 'node_modules/x' || s_suppkey || '.py' WHEN 1 THEN '.hidden/a' || s_suppkey || '.ts' WHEN 2 THEN '.github/b' || s_suppkey || '.ts' WHEN 3 THEN 'target/c' || s_suppkey || '.ts' WHEN 4 THEN 'src/target/d' || s_suppkey || '.ts' ELSE 'src/e' || s_suppkey || '.ts' END")
    return table(spark, sf_dir, "supplier").select(path.alias("path")).where(paths.is_ignored(F.col("path")))


@query("ignore_rules", """WITH p AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'logs/' WHEN 1 THEN 'src/logs/' ELSE 'src/' END || 'f' || c_custkey || CASE c_custkey % 2 WHEN 0 THEN '.gen.ts' ELSE '.ts' END AS path FROM customer)
  SELECT path FROM p WHERE CASE WHEN k % 3 <> 0 AND path LIKE 'src/%f1%' THEN false WHEN k % 3 = 0 THEN true ELSE k % 2 = 0 END""")
def ignore_rules(spark, sf_dir):
    """Paths that ignore files of two levels ignore; the deeper one brings some back."""
    path = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'logs/' WHEN 1 THEN 'src/logs/' ELSE 'src/' END || 'f' || c_custkey || CASE c_custkey % 2 WHEN 0 THEN '.gen.ts' ELSE '.ts' END")
    rules = spark.createDataFrame([(".gitignore", "# all levels\n*.gen.ts\n/logs\n"), ("src/.gitignore", "!*f1*\n")], "path string, text string")
    return file_source.ignored_paths(table(spark, sf_dir, "customer").select(path.alias("path")), file_source.ignore_rules(rules))


@query("structural_targets", f"SELECT path FROM (SELECT {_PATH} AS path FROM part) WHERE path LIKE 'src/core/%' OR path LIKE 'tests/%'")
def structural_targets(spark, sf_dir):
    """Files in either of two directories."""
    return file_source.targets(part_paths(spark, sf_dir), ["src/core", "tests/"]).select("path")


@query("concept_paths", f"SELECT path FROM (SELECT {_PATH} AS path FROM part) WHERE path LIKE '%core%' AND path LIKE '%p10%'")
def concept_paths(spark, sf_dir):
    """Code whose path names both words."""
    return search.concept_paths(part_paths(spark, sf_dir), "the core of p10")


@query("text_filters", """SELECT p_partkey, coalesce(regexp_matches(p_type, '^[A-Z].*E'), false) AS pattern, contains(p_type, '([') AS broken, p_type LIKE 'S%D %' AS glob FROM part""")
def text_filters(spark, sf_dir):
    """A pattern, a pattern that doesn't compile, and a glob."""
    v = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.text_filter(v, "^[A-Z].*E").alias("pattern"), text.text_filter(v, "([").alias("broken"), text.glob_filter(v, "S*D *").alias("glob"))


@query("common_prefixes", "SELECT o_orderkey, len(list_filter(generate_series(1, least(length(a), length(b))), lambda i: a[1:i] = b[1:i]))::INT AS n FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS a, (o_orderkey + o_custkey)::VARCHAR AS b FROM orders)")
def common_prefixes(spark, sf_dir):
    """Length of what two texts begin with alike."""
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", text.common_prefix(F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + F.col("o_custkey")).cast("string")).alias("n"))


_SOURCE = "CASE p_partkey % 4 WHEN 0 THEN 'class Store' || p_partkey || ':' || chr(10) || '  def save(self):' WHEN 1 THEN 'export const save = 1' || chr(10) || 'resave()' WHEN 2 THEN 'x = save' ELSE 'func save() {' END"


@query("definition_lines", f"""SELECT path, line, text FROM (SELECT 'f' || p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 1 END AS line, CASE p_partkey % 4 WHEN 0 THEN 'def save(self):' WHEN 1 THEN 'export const save = 1' WHEN 3 THEN 'func save() {{' END AS text FROM part) WHERE text IS NOT NULL""")
def definition_lines(spark, sf_dir):
    """Lines that declare a name."""
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.expr(_SOURCE).alias("text"))
    return search.definition_matches(files, "save")


@query("owner_files", "SELECT 'f' || p_partkey AS path FROM part WHERE p_partkey = 8")
def owner_files(spark, sf_dir):
    """Files that declare a class of one name."""
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.expr(_SOURCE).alias("text"))
    return search.owner_files(files, "Store8")


@query("file_roles", """WITH f AS (SELECT l_orderkey, 'a/f' || l_orderkey || CASE l_orderkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.test.ts' WHEN 2 THEN '/types.ts' ELSE '.ts' END AS file, count(*) AS defines, sum(l_linenumber) % 5 AS imports_local, min(l_suppkey) % 7 AS exports, min(l_partkey) % 2 AS extends, 0 AS inherits, max(l_suppkey) % 3 AS decorators, l_orderkey % 5 AS reexports_local, l_orderkey % 11 = 0 AS entry FROM lineitem GROUP BY l_orderkey)
  SELECT file, CASE WHEN entry THEN 'likely entrypoint' WHEN l_orderkey % 4 = 1 THEN 'likely test/support' WHEN l_orderkey % 4 = 0 AND defines >= 8 THEN 'likely script hub' WHEN reexports_local > 0 AND defines = 0 AND imports_local = 0 THEN 'likely barrel' WHEN l_orderkey % 4 = 2 THEN 'likely contracts'
    WHEN defines >= 6 OR defines >= 3 AND imports_local >= 2 OR decorators >= 2 THEN 'likely hub' WHEN exports >= 5 AND imports_local = 0 AND defines <= 1 THEN 'likely contracts' WHEN imports_local >= 3 THEN 'likely integration' ELSE 'likely module' END AS role,
    (defines * 5 + imports_local * 6 + (extends + inherits) * 3 + decorators * 2 + exports)::BIGINT AS score FROM f""")
def file_roles(spark, sf_dir):
    """What each profiled file is likely for, and its weight."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("defines"), (F.sum("l_linenumber") % 5).alias("imports_local"), (F.min("l_suppkey") % 7).alias("exports"), (F.min("l_partkey") % 2).alias("extends"), F.lit(0).alias("inherits"), (F.max("l_suppkey") % 3).alias("decorators"))
    name = F.concat(F.lit("a/f"), k, F.expr("CASE l_orderkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.test.ts' WHEN 2 THEN '/types.ts' ELSE '.ts' END"))
    rows = rows.withColumn("file", name).withColumn("reexports_local", k % 5).withColumn("entry", k % 11 == 0)
    return rows.select("file", facts.role().alias("role"), facts.score().cast("long").alias("score"))


_MODULES = """x AS (SELECT 'n' || l_partkey % 90 AS name, CASE l_suppkey % 4 WHEN 0 THEN 'pkg' || l_suppkey % 9 || '/index.ts' WHEN 1 THEN 'ext' || l_suppkey % 3 ELSE 'src/m' || l_suppkey % 9 || '.ts' END AS origin FROM lineitem),
  o AS (SELECT DISTINCT origin, CASE WHEN origin LIKE 'pkg%' THEN regexp_extract(origin, '^([^/]+)/', 1) ELSE regexp_extract(regexp_replace(origin, '^.*/', ''), '^([^.]+)', 1) END AS label, CASE WHEN origin LIKE 'ext%' THEN NULL ELSE length(origin) * 7 + ascii(right(split_part(origin, '.', 1), 1)) END AS n_lines, CASE WHEN origin LIKE 'src%' THEN ascii(right(split_part(origin, '.', 1), 1)) % 5 END AS fan FROM x),
  m AS (SELECT label, count(DISTINCT x.origin) AS origins, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, coalesce(max(fan), 0) AS fan_in, coalesce(max(n_lines), 0) AS implementation FROM x JOIN o USING (origin) GROUP BY label)"""


def _modules(spark, sf_dir):
    name = F.concat(F.lit("n"), F.col("l_partkey") % 90)
    origin = F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'pkg' || l_suppkey % 9 || '/index.ts' WHEN 1 THEN 'ext' || l_suppkey % 3 ELSE 'src/m' || l_suppkey % 9 || '.ts' END")
    exports = table(spark, sf_dir, "lineitem").select(name.alias("name"), origin.alias("origin"))
    last = F.expr("ascii(right(split_part(origin, '.', 1), 1))")
    origins = exports.select("origin").distinct()
    lines = origins.where("origin NOT LIKE 'ext%'").select(F.col("origin").alias("path"), (F.length("origin") * 7 + last).alias("n_lines"))
    fan = origins.where("origin LIKE 'src%'").select(F.col("origin").alias("node"), (last % 5).alias("importers"))
    return surfaces.exposed_modules(exports, fan, lines).select("label", "origins", "names", "fan_in", "implementation")


@query("exposed_modules", f"WITH {_MODULES} SELECT * FROM m")
def exposed_modules(spark, sf_dir):
    """Modules that a surface shows: where from, which names, how much used and how long."""
    return _modules(spark, sf_dir).withColumn("names", F.array_join("names", ","))


@query("shown_modules", f"""WITH {_MODULES}, front AS (SELECT label FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.fan_in >= a.fan_in AND b.origins >= a.origins AND b.implementation >= a.implementation AND (b.fan_in > a.fan_in OR b.origins > a.origins OR b.implementation > a.implementation))),
  wide AS (SELECT label FROM m WHERE (SELECT stddev_samp(fan_in) FROM m) > 0 AND fan_in >= (SELECT avg(fan_in) + stddev_samp(fan_in) FROM m)) SELECT label FROM front UNION SELECT label FROM wide""")
def shown_modules(spark, sf_dir):
    """Modules that no other passes, and the most used."""
    return surfaces.shown_modules(_modules(spark, sf_dir)).select("label")


@query("docstring_totals", """WITH d AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'class' WHEN event_id % 3 = 1 THEN 'method' ELSE 'function' END AS kind, event_id % 4 > 0 AS doc FROM events) SELECT kind, count(*) AS total, count(*) FILTER (doc) AS present FROM d GROUP BY kind""")
def docstring_totals(spark, sf_dir):
    """Definitions and documented ones, by kind."""
    return facts.documentation_totals(event_docs(spark, sf_dir))


@query("json_items", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 5 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END::INT AS items FROM events")
def json_items(spark, sf_dir):
    """Items of the arrays of a JSON text; arrays inside rows are part of them."""
    made = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"a": [1, [2, 3], {"b": [4]}], "c": {"d": [5]}}' WHEN 1 THEN '[{"x": [1, 2]}]' ELSE '{"a": 1}' END""")
    return table(spark, sf_dir, "events").select("event_id", payload.item_count(made).alias("items"))


@query("child_boundaries", """SELECT DISTINCT 'top/n' || c_nationkey AS boundary FROM customer UNION SELECT 'top'""")
def child_boundaries(spark, sf_dir):
    """First-level directories of the root that holds most files."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("top/n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".ts")).alias("path"))
    few = table(spark, sf_dir, "nation").select(F.concat(F.lit("other/x"), "n_nationkey", F.lit(".ts")).alias("path"))
    return surfaces.child_boundaries(rows.unionByName(few).unionByName(spark.createDataFrame([("top/main.ts",)], "path string")))
