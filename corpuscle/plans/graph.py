"""Queries over graphs: customers buy from suppliers, nations are the boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import graph, stats
from corpuscle.plans.registry import query
from corpuscle.sources.tables import table

_EDGES = """e AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""
_STEPS = """r AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, user_id FROM events),
  s AS (SELECT a || user_id AS source, b || (user_id + 1) AS target, count(*) AS weight FROM r WHERE b IS NOT NULL GROUP BY 1, 2)"""
_NATIONS = f"""{_EDGES}, owner AS (SELECT 'c' || c_custkey AS node, c_nationkey AS boundary FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
  b AS (SELECT x.boundary AS source, y.boundary AS target, sum(weight)::BIGINT AS weight FROM e JOIN owner x ON e.source = x.node JOIN owner y ON e.target = y.node WHERE x.boundary <> y.boundary GROUP BY 1, 2)"""


def edges(spark, sf_dir):
    """customer -> supplier, weighted by line items."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.concat(F.lit("c"), F.col("o_custkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target")).agg(F.count("*").alias("weight"))


def steps(spark, sf_dir):
    """Transitions between event types, from each user to the next: a graph that grows with the users."""
    from pyspark.sql import Window

    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("a"), after.alias("b")).where("b IS NOT NULL")
    at = lambda c, k: F.concat(c, (F.col("user_id") + k).cast("string"))
    return rows.groupBy(at("a", 0).alias("source"), at("b", 1).alias("target")).agg(F.count("*").alias("weight"))


def boundary(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_nationkey").alias("boundary"))
    owners = owners.union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")), "s_nationkey"))
    return graph.boundary_edges(edges(spark, sf_dir), owners)


@query("graph_edges", f"WITH {_EDGES} SELECT * FROM e")
def graph_edges(spark, sf_dir):
    """Weighted edges."""
    return edges(spark, sf_dir)


@query("graph_degrees", f"""WITH {_STEPS}, a AS (SELECT source AS node, true AS o FROM s UNION ALL SELECT target, false FROM s WHERE source <> target),
  i AS (SELECT target AS node, count(*) AS fan_in FROM s GROUP BY 1) SELECT a.node, count(*) AS degree, coalesce(any_value(fan_in), 0) AS fan_in, count(*) FILTER (o) AS fan_out FROM a LEFT JOIN i ON a.node = i.node GROUP BY a.node""")
def graph_degrees(spark, sf_dir):
    """Degree, fan-in and fan-out of each node."""
    return graph.degrees(steps(spark, sf_dir))


@query("graph_importers", f"WITH {_EDGES} SELECT target AS node, count(DISTINCT source) AS importers FROM e GROUP BY target")
def graph_importers(spark, sf_dir):
    """Distinct sources of each target."""
    return graph.fan_in(edges(spark, sf_dir))


@query("graph_adjacency", f"WITH {_STEPS} SELECT source AS node, target AS other, true AS outgoing FROM s UNION ALL SELECT target, source, false FROM s WHERE source <> target")
def graph_adjacency(spark, sf_dir):
    """Edges from both ends."""
    return graph.adjacency(steps(spark, sf_dir))


@query("graph_two_hop", f"""WITH {_STEPS}, one AS (SELECT DISTINCT source, target FROM s), t AS (SELECT * FROM one UNION SELECT a.source, b.target FROM one a JOIN one b ON a.target = b.source)
  SELECT source AS node, count(*) AS reach FROM t GROUP BY source""")
def graph_two_hop(spark, sf_dir):
    """Nodes within two steps."""
    return graph.two_hop(steps(spark, sf_dir))


@query("graph_k_hops", f"""WITH RECURSIVE {_STEPS}, k(node, hop) AS (SELECT 'click0', 0 UNION SELECT s.target, hop + 1 FROM k JOIN s ON s.source = k.node WHERE hop < 3)
  SELECT node, min(hop)::INT AS hop FROM k WHERE node <> 'click0' GROUP BY node""")
def graph_k_hops(spark, sf_dir):
    """Nodes within three steps of one, with the fewest."""
    return graph.k_hops(steps(spark, sf_dir), spark.createDataFrame([("click0",)], "node string"), 3)


@query("graph_trace", f"""WITH RECURSIVE {_STEPS}, f(node, hop) AS (SELECT 'click0', 0 UNION SELECT s.target, hop + 1 FROM f JOIN s ON s.source = f.node WHERE hop < 2),
  b(node, hop) AS (SELECT 'click0', 0 UNION SELECT s.source, hop + 1 FROM b JOIN s ON s.target = b.node WHERE hop < 2)
  SELECT node, 'callee' AS direction, min(hop)::INT AS hop FROM f WHERE node <> 'click0' GROUP BY node UNION ALL SELECT node, 'caller', min(hop)::INT FROM b WHERE node <> 'click0' GROUP BY node""")
def graph_trace(spark, sf_dir):
    """Callers and callees of one node within two steps."""
    return graph.trace(steps(spark, sf_dir), "click0")


@query("change_impact", f"""WITH RECURSIVE {_STEPS}, c AS (SELECT DISTINCT source AS node FROM s WHERE weight % 7 = 0 AND source LIKE 'click%'),
  k(node, hop) AS (SELECT node, 0 FROM c UNION SELECT s.source, hop + 1 FROM k JOIN s ON s.target = k.node WHERE hop < 2) SELECT node, min(hop)::INT AS hop FROM k GROUP BY node""")
def change_impact(spark, sf_dir):
    """What two steps of dependents the changed nodes have."""
    s = steps(spark, sf_dir)
    before = s.select(F.col("source").alias("node")).distinct().withColumn("digest", F.lit(0))
    changed = s.where((F.col("weight") % 7 == 0) & F.col("source").startswith("click")).select(F.col("source").alias("node")).distinct().withColumn("new", F.lit(1))
    after = before.join(changed, "node", "left").select("node", F.coalesce("new", "digest").alias("digest"))
    return graph.change_impact(before, after, s, 2)


@query("boundary_edges", f"WITH {_NATIONS} SELECT * FROM b")
def boundary_edges(spark, sf_dir):
    """Edges between nations, inner ones dropped."""
    return boundary(spark, sf_dir)


@query("structural_roles", f"""WITH {_NATIONS}, one AS (SELECT DISTINCT source, target FROM b), two AS (SELECT * FROM one UNION SELECT x.source, y.target FROM one x JOIN one y ON x.target = y.source),
  outs AS (SELECT source AS node, count(*) AS n, sum(weight) AS w FROM b GROUP BY 1), ins AS (SELECT target AS node, count(*) AS n, sum(weight) AS w FROM b GROUP BY 1),
  wide AS (SELECT two.source AS node, count(*) AS n, any_value(w) AS w FROM two JOIN outs ON outs.node = two.source GROUP BY 1),
  en AS (SELECT * FROM (SELECT *, rank() OVER (ORDER BY n DESC, w DESC) AS r FROM wide) WHERE r = 1 QUALIFY count(*) OVER () = 1),
  co AS (SELECT * FROM (SELECT *, rank() OVER (ORDER BY n DESC, w DESC) AS r FROM outs WHERE n >= 2) WHERE r = 1 QUALIFY count(*) OVER () = 1),
  fo AS (SELECT * FROM (SELECT *, rank() OVER (ORDER BY n DESC, w DESC) AS r FROM ins WHERE n >= 2) WHERE r = 1 QUALIFY count(*) OVER () = 1),
  k AS (SELECT count(DISTINCT x) AS k FROM (SELECT source AS x FROM b UNION SELECT target FROM b))
  SELECT 'entry' AS role, node, NULL::DOUBLE AS share FROM en UNION ALL
  SELECT CASE WHEN co.node IS NOT NULL AND fo.node IS NOT NULL THEN 'core' WHEN co.node IS NOT NULL THEN 'coordination' ELSE 'foundation' END, coalesce(co.node, fo.node),
    CASE WHEN fo.node IS NOT NULL AND k > 1 THEN fo.n / (k - 1) END FROM (co FULL JOIN fo ON co.node = fo.node), k""")
def structural_roles(spark, sf_dir):
    """Entry, coordination and foundation among nations."""
    b = boundary(spark, sf_dir).persist()  # used six times; one row for each pair of boundaries
    return graph.roles(b, b.select(F.col("source").alias("node")))


@query("import_boundary", f"""WITH {_STEPS}, p AS (SELECT DISTINCT source, target FROM s) SELECT source, target, 'out' AS direction FROM p WHERE source LIKE 'click%' AND target NOT LIKE 'click%'
  UNION ALL SELECT source, target, 'in' FROM p WHERE target LIKE 'click%' AND source NOT LIKE 'click%'""")
def import_boundary(spark, sf_dir):
    """Edges that cross a set of nodes."""
    s = steps(spark, sf_dir)
    inside = s.select(F.col("source").alias("node")).union(s.select("target")).where("node LIKE 'click%'")
    return graph.import_boundary(s, inside)


@query("widened_set", f"WITH {_STEPS} SELECT 'click0' AS node UNION SELECT target FROM s WHERE source = 'click0' UNION SELECT source FROM s WHERE target = 'click0'")
def widened_set(spark, sf_dir):
    """A node with its neighbours."""
    return graph.widened(steps(spark, sf_dir), spark.createDataFrame([("click0",)], "node string"))


@query("schema_counts", f"WITH {_EDGES} SELECT 'labels' AS part, 'customer' AS name, count(DISTINCT source) AS n FROM e UNION ALL SELECT 'labels', 'supplier', count(DISTINCT target) FROM e UNION ALL SELECT 'types', CASE WHEN weight > 1 THEN 'OFTEN' ELSE 'ONCE' END, count(*) FROM e GROUP BY 2")
def schema_counts(spark, sf_dir):
    """Nodes of each label and edges of each type."""
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("source").alias("id"), F.lit("customer").alias("type")).union(e.select("target", F.lit("supplier"))).distinct()
    return graph.schema_counts(nodes, e.withColumn("type", F.when(F.col("weight") > 1, "OFTEN").otherwise("ONCE")))


@query("most_called", f"WITH {_EDGES} SELECT target, count(*) AS fan_in, count(*) / (SELECT count(*) FROM e) AS share FROM e GROUP BY target ORDER BY fan_in DESC, target LIMIT 10")
def most_called(spark, sf_dir):
    """The ten most reached targets and their part of all edges."""
    return stats.shares(edges(spark, sf_dir), "target", F.lit(1)).select("target", F.col("weight").alias("fan_in"), "share").orderBy(F.desc("fan_in"), "target").limit(10)


@query("label_clusters", f"""WITH {_STEPS}, bo AS (SELECT source, target, sum(weight) AS weight FROM (SELECT * FROM s UNION ALL SELECT target, source, weight FROM s) GROUP BY 1, 2),
  l0 AS (SELECT DISTINCT source AS node, source AS cluster FROM bo),
  v1 AS (SELECT bo.source AS node, cluster, sum(weight) AS v FROM bo JOIN l0 ON l0.node = bo.target GROUP BY 1, 2), l1 AS (SELECT node, cluster FROM v1 QUALIFY row_number() OVER (PARTITION BY node ORDER BY v DESC, cluster) = 1),
  v2 AS (SELECT bo.source AS node, cluster, sum(weight) AS v FROM bo JOIN l1 ON l1.node = bo.target GROUP BY 1, 2), l2 AS (SELECT node, cluster FROM v2 QUALIFY row_number() OVER (PARTITION BY node ORDER BY v DESC, cluster) = 1)
  SELECT node, cluster FROM l2""")
def label_clusters(spark, sf_dir):
    """Clusters after two rounds of label propagation."""
    return graph.clusters(steps(spark, sf_dir), 2)


_BM25 = """WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
  c AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x = 'licensed')) AS tf0, len(list_filter(t, lambda x: x = 'under')) AS tf1 FROM d),
  f AS (SELECT count(*) AS docs, avg(n) AS av, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM c)
  SELECT id, round(ln(1 + (docs - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (1 - 0.75 + 0.75 * n / av)) + ln(1 + (docs - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (1 - 0.75 + 0.75 * n / av)), 8) AS score
  FROM c, f WHERE tf0 > 0 OR tf1 > 0"""


@query("bm25_rank", _BM25)
def bm25_rank(spark, sf_dir):
    """BM25 scores of a two-word query."""
    tokens = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != "")
    return graph.bm25(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ["licensed", "under"], tokens).withColumn("score", F.round("score", 8))


@query("cosine_neighbours", """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) /
  (sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * sqrt(list_dot_product(q, q))) AS c FROM embeddings, q) SELECT id, round(c, 6) AS score FROM s WHERE c >= 0.5""")
def cosine_neighbours(spark, sf_dir):
    """Vectors with a cosine of a half or more with the first."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = vectors.where("id = 0").first().vector
    return graph.cosine(vectors, q).where("score >= 0.5").withColumn("score", F.round("score", 6))


@query("owning_boundary", """WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS path FROM pages), b AS (SELECT unnest(['', 'en', 'fr', 'fr/1', 'de/2']) AS boundary),
  j AS (SELECT path, boundary, row_number() OVER (PARTITION BY path ORDER BY length(boundary) DESC) AS r FROM p JOIN b ON boundary = '' OR path = boundary OR starts_with(path, boundary || '/')) SELECT path, boundary FROM j WHERE r = 1""")
def owning_boundary(spark, sf_dir):
    """The deepest of some directories that holds each page."""
    from corpuscle.functions import paths

    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1).alias("path")).distinct()
    boundaries = spark.createDataFrame([(b,) for b in ("", "en", "fr", "fr/1", "de/2")], "boundary string")
    return graph.owning_boundary(pages, boundaries, paths.ancestors(F.col("path")))
