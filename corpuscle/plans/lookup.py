"""Loose values: JSON cells, spans, tabular payloads, name shaping, HTML outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import payload
from corpuscle.plans.registry import query
from corpuscle.sources.tables import table


@query("json_narrowing", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, json_extract_string(props, '$.page') AS page FROM events")
def json_narrowing(spark, sf_dir):
    """Typed fields of loose JSON with defaults."""
    return table(spark, sf_dir, "events").select("event_id", payload.number(F.get_json_object("props", "$.k")).alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("identifier_tokens", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9_]*\b')) AS name FROM documents WHERE doc_id % 1 = 0)
  SELECT name, array_to_string(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens FROM w""")
def identifier_tokens(spark, sf_dir):
    """Parts of every distinct name."""
    names = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(text.IDENTIFIER), F.lit(0))).alias("name")).distinct()
    return names.select("name", F.array_join(text.identifier_tokens(F.col("name")), " ").alias("tokens"))


@query("html_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL""")
def html_links(spark, sf_dir):
    """Links of every page."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("html_headings", r"""SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages""")
def html_headings(spark, sf_dir):
    """Heading and paragraphs of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


@query("first_sentences", r"""WITH p AS (SELECT doc_id, trim(regexp_replace(string_split_regex(trim(text), '\n\s*\n')[1], '\s+', ' ', 'g')) AS p FROM documents)
  SELECT doc_id, nullif(coalesce(nullif(regexp_extract(p, '^(.*?[.!?])(\s|$)', 1), ''), p), '') AS sentence FROM p""")
def first_sentences(spark, sf_dir):
    """The first sentence of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("spans", "WITH s AS (SELECT o_orderkey, (o_orderkey % 500)::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '-' || (o_orderkey % 500 + 7) END AS v FROM orders) SELECT o_orderkey, CASE WHEN regexp_full_match(v, '\\d+-\\d+') THEN split_part(v, '-', 1)::BIGINT END AS a, CASE WHEN regexp_full_match(v, '\\d+-\\d+') THEN split_part(v, '-', 2)::BIGINT END AS b FROM s")
def spans(spark, sf_dir):
    """Line spans of loose text, null where it is none."""
    k = F.col("o_orderkey")
    v = F.concat((k % 500).cast("string"), F.when(k % 3 == 0, "x").otherwise(F.concat(F.lit("-"), (k % 500 + 7).cast("string"))))
    s = text.line_span(v)
    return table(spark, sf_dir, "orders").select("o_orderkey", s["start"].alias("a"), s["end"].alias("b"))


@query("extent_samples", "WITH g AS (SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS l FROM customer GROUP BY 1) SELECT c_nationkey, unnest(CASE WHEN len(l) <= 3 THEN l ELSE list_distinct([l[1], l[(len(l) - 1) // 2 + 1], l[-1]]) END) AS c_custkey FROM g")
def extent_samples(spark, sf_dir):
    """First, middle and last customer of each nation."""
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("l"))
    return g.select("c_nationkey", F.explode(text.extent_sample(F.col("l"))).alias("c_custkey"))
