"""Ranked metrics: winners, top-k, outliers, skylines, interval membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import stats
from corpuscle.plans.registry import query
from corpuscle.sources.tables import table


@query("argmax_per_key", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def argmax_per_key(spark, sf_dir):
    """The largest line of each supplier, the earliest of equals."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.best_per_key(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])


@query("topk_total_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_total_order(spark, sf_dir):
    """The 50 largest orders, ties by key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("per_key_cap", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 2")
def per_key_cap(spark, sf_dir):
    """The first two lines of each order."""
    return stats.first_n_per_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], [F.col("l_linenumber")], 2)


@query("upper_outliers", "WITH s AS (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS d FROM part) SELECT p_partkey, p_retailprice FROM part, s WHERE d > 0 AND p_retailprice >= m + d")
def upper_outliers(spark, sf_dir):
    """Parts a sample deviation or more above the mean price."""
    return stats.upper_outliers(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query("skyline_suppliers", """WITH m AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity)::BIGINT AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1)
  SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.n >= a.n AND b.q >= a.q AND b.p >= a.p AND (b.n > a.n OR b.q > a.q OR b.p > a.p))""")
def skyline_suppliers(spark, sf_dir):
    """Suppliers that no other reaches in count, quantity and price."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.max("l_extendedprice").alias("p"))
    return stats.skyline(m, ["n", "q", "p"])


@query("unique_winner", """WITH m AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1)
  SELECT l_suppkey, n, q FROM (SELECT *, rank() OVER (ORDER BY n DESC, q DESC) AS r FROM m) WHERE r = 1 QUALIFY count(*) OVER () = 1""")
def unique_winner(spark, sf_dir):
    """The one supplier of most orders, then quantity; none on a tie."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    return stats.unique_winner(m, "n", "q")


@query("capped_surfaces", """WITH o AS (SELECT o_orderkey, o_orderpriority LIKE '1%' AS surface, o_totalprice FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY o_totalprice DESC, o_orderkey) AS r FROM o),
  d AS (SELECT *, surface AND r > 2 AS later FROM k) SELECT o_orderkey, surface, o_totalprice FROM d ORDER BY later, o_totalprice DESC, o_orderkey LIMIT 8""")
def capped_surfaces(spark, sf_dir):
    """The eight best orders with at most two of one kind, unless others run out."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").startswith("1").alias("surface"), "o_totalprice")
    return stats.capped(o, "surface", [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 8)


@query("span_members", """WITH p AS (SELECT event_id AS s, user_id, ts AS t0, ts + INTERVAL 2 HOUR AS t1 FROM events WHERE event_type = 'purchase')
  SELECT e.event_id, max_by(p.s, (p.t0, p.s)) AS span FROM events e JOIN p ON e.user_id = p.user_id AND p.t0 < e.ts AND e.ts < p.t1 GROUP BY e.event_id""")
def span_members(spark, sf_dir):
    """The innermost span that strictly holds each event; user is the equal key, time the range."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hours = 2 * 3600 * 1_000_000
    spans = e.where("event_type = 'purchase'").select(F.col("id").alias("span"), "key", F.col("at").alias("start"), (F.col("at") + hours).alias("stop"))
    return stats.innermost_spans(e.select("id", "key", "at"), spans, hours).withColumnRenamed("id", "event_id")


@query("relationship_counts", """WITH f AS (SELECT 'f' || l_orderkey || CASE WHEN l_orderkey % 3 = 0 THEN '.py' ELSE '.ts' END AS file, sum(l_linenumber) AS imports_local, count(*) FILTER (l_returnflag = 'R') AS extends, count(*) FILTER (l_linestatus = 'F') AS inherits,
  count(*) FILTER (l_discount > 0.05) AS reexports_local, min(l_linenumber) AS relative, min(l_suppkey) % 10 = 0 AS entry FROM lineitem GROUP BY l_orderkey), g AS (SELECT *, file LIKE '%.py' AS py FROM f)
  SELECT count(*) AS files, sum(imports_local) FILTER (py)::BIGINT AS python_imports, sum(imports_local) FILTER (NOT py)::BIGINT AS script_imports, count(*) FILTER (entry) AS entrypoints, sum(relative) FILTER (NOT py)::BIGINT AS script_relative,
  sum(relative) FILTER (py)::BIGINT AS python_relative, sum(reexports_local) FILTER (NOT py)::BIGINT AS script_reexports, sum(inherits) FILTER (py)::BIGINT AS python_inheritance, sum(extends) FILTER (NOT py)::BIGINT AS script_inheritance,
  count(*) FILTER (imports_local > 0) AS importing FROM g""")
def relationship_counts(spark, sf_dir):
    """Ten conditional counts and sums over profiled files, in one pass."""
    from corpuscle.operators import profiles

    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_linenumber").alias("imports_local"), F.count_if(F.col("l_returnflag") == "R").alias("extends"), F.count_if(F.col("l_linestatus") == "F").alias("inherits"),
        F.count_if(F.col("l_discount") > 0.05).alias("reexports_local"), F.min("l_linenumber").alias("relative"), (F.min("l_suppkey") % 10 == 0).alias("entry"))
    name = F.concat(F.lit("f"), "l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, ".py").otherwise(".ts"))
    return profiles.relationship_counts(rows.withColumn("file", name))


@query("share_threshold", """WITH w AS (SELECT lang, sum(octet_length(encode(text))) AS b FROM documents GROUP BY 1) SELECT lang, b::BIGINT AS bytes FROM w WHERE b >= 0.2 * (SELECT sum(b) FROM w)""")
def share_threshold(spark, sf_dir):
    """Languages of a fifth of all bytes or more."""
    s = stats.shares(table(spark, sf_dir, "documents"), "lang", F.octet_length("text"))
    return s.where("share >= 0.2").select("lang", F.col("weight").alias("bytes"))


@query("adjacent_groups", """WITH t AS (SELECT conv_id, turn, role, (role <> lag(role) OVER w OR lag(role) OVER w IS NULL)::INT AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t) SELECT conv_id, k::BIGINT AS block, any_value(role) AS role, count(*) AS turns FROM g GROUP BY conv_id, k""")
def adjacent_groups(spark, sf_dir):
    """Neighbours of one kind as one group."""
    return stats.adjacent_groups(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").withColumnRenamed("rows", "turns")
