"""Public surfaces: which names a package shows, where they come from, which to name first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import paths, text
from corpuscle.operators import graph, stats


def _singular(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "s$", "")


def affinity(label: Column, name: Column) -> Column:
    """How many parts of a name share four letters' beginning with a part of the label."""
    parts = text.identifier_tokens(label)
    near = F.filter(text.identifier_tokens(name), lambda t: F.exists(parts, lambda p: (F.length(p) >= 4) & (F.length(t) >= 4) & (F.substring(p, 1, 4) == F.substring(t, 1, 4))))
    return F.size(near)


def role_names(exports: DataFrame) -> DataFrame:
    """Of (label, name) the names that match a label: the same but for a plural, else the closest with fewest other parts."""
    rows = exports.where(~F.startswith("name", F.lit("_"))).withColumn("_same", (_singular(F.col("label")) == _singular(F.col("name"))).cast("int")).withColumn("_near", affinity(F.col("label"), F.col("name")))
    rows = rows.withColumn("_more", F.size(text.identifier_tokens(F.col("name"))) - F.col("_near")).where("_same = 1 OR _near > 0")
    best = rows.groupBy("label").agg(F.max(F.struct("_same", "_near", -F.col("_more"))).alias("_b"))
    fits = (F.col("_b._same") == 1) & (F.col("_same") == 1) | (F.col("_b._same") == 0) & (F.col("_near") == F.col("_b._near")) & (-F.col("_more") == F.col("_b.col3"))
    return rows.join(best, "label").where(fits).select("label", "name")


def exposed_modules(exports: DataFrame, fan_in: DataFrame, lines: DataFrame) -> DataFrame:
    """(label, origins, names, fan_in, implementation, external) of (name, origin): one row for each module shown.

    The label is the module's stem, of an index its folder's. ``fan_in``: node, importers;
    ``lines``: path, n_lines. An origin that is no file is external.
    """
    stem = F.regexp_extract(paths.basename(F.col("origin")), r"^([^.]+)", 1)
    label = F.when(paths.is_conventional_surface(F.col("origin")), paths.basename(paths.dirname(F.col("origin")))).otherwise(stem)
    rows = exports.join(fan_in.select(F.col("node").alias("origin"), "importers"), "origin", "left").join(lines.select(F.col("path").alias("origin"), "n_lines"), "origin", "left")
    return rows.withColumn("label", label).groupBy("label").agg(
        F.count_distinct("origin").alias("origins"), F.array_sort(F.collect_set("name")).alias("names"), F.coalesce(F.max("importers"), F.lit(0)).alias("fan_in"), F.coalesce(F.max("n_lines"), F.lit(0)).alias("implementation"), F.bool_and(F.col("n_lines").isNull()).alias("external"),
    )


def shown_modules(modules: DataFrame) -> DataFrame:
    """Modules that no other passes in fan-in, origins and implementation, and outliers of these."""
    front = stats.skyline(modules, ["fan_in", "origins", "implementation"])
    wide = stats.upper_outliers(modules, "fan_in")
    return front.unionByName(wide.join(front.select("label"), "label", "left_anti").select(*front.columns))


def primary_root(files: DataFrame) -> str | None:
    """The top Python package that holds most files, else the deepest directory that does; None without a majority."""
    n = files.count()
    packages = files.where(paths.basename(F.col("path")) == "__init__.py").select(paths.dirname(F.col("path")).alias("prefix")).distinct()
    tops = packages.withColumn("_up", paths.dirname(F.col("prefix"))).join(packages.select(F.col("prefix").alias("_up")), "_up", "left_anti").select("prefix")
    counts = stats.ancestor_counts(files, paths.ancestors(F.col("path"))).where(F.col("n") * 2 > n)
    best = counts.join(tops, "prefix").orderBy(F.desc("n"), paths.depth(F.col("prefix")), "prefix").first() or counts.orderBy(F.desc(paths.depth(F.col("prefix"))), F.desc("n"), "prefix").first()
    return best.prefix if best else None


def child_boundaries(files: DataFrame) -> DataFrame:
    """(boundary): first-level directories below the primary root of files (path), and the root itself if it owns files."""
    top = primary_root(files) or ""
    inner = F.expr(f"substring(path, {len(top) + 2})") if top else F.col("path")
    inside = files.where(F.startswith("path", F.lit(top + "/"))) if top else files
    child = F.concat(F.lit(top + "/" if top else ""), F.substring_index(inner, "/", 1))
    return inside.select(F.when(F.contains(inner, F.lit("/")), child).otherwise(F.lit(top)).alias("boundary")).distinct()


def unique_symbols(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, path) of wanted (name, qualified) that mean one symbol: the only one of its name, or the only one whose path the qualified name holds."""
    rows = wanted.join(symbols.select("name", "path"), "name").withColumn("_in", F.contains("qualified", F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/", ".")))
    counted = rows.groupBy("name", "qualified").agg(F.count_distinct("path").alias("_n"), F.count_distinct(F.when(F.col("_in"), F.col("path"))).alias("_k"), F.min("path").alias("_p"), F.min(F.when(F.col("_in"), F.col("path"))).alias("_q"))
    return counted.where("_n = 1 OR _k = 1").select("name", "qualified", F.when(F.col("_n") == 1, F.col("_p")).otherwise(F.col("_q")).alias("path"))


def merged_metrics(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``first``, then those of ``second`` whose key it lacks; ``lane`` says which."""
    rest = second.join(first.select(*key).distinct(), key, "left_anti")
    return first.withColumn("lane", F.lit(1)).unionByName(rest.withColumn("lane", F.lit(2)), allowMissingColumns=True)


def enclosing_definitions(hits: DataFrame, defs: DataFrame) -> DataFrame:
    """(path, name, matches) of text hits (path, line), counted by their innermost definition."""
    spans = defs.where("kind IN ('function', 'class')").select("path", "name", F.col("line").alias("_s"), (F.col("line") + F.col("span") - 1).alias("_e"))
    inner = hits.select("path", "line").join(spans, "path").where("_s <= line AND line <= _e").groupBy("path", "line").agg(F.max_by("name", F.struct("_s", -F.col("_e"))).alias("name"))
    return inner.groupBy("path", "name").agg(F.count("*").alias("matches"))


def related_sections(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """(label, other, file_path) of a node's edges, worded from its side."""
    near = graph.adjacency(edges.select("source", "target")).where(F.col("node") == node_id).join(edges.select("source", "target", "type"), (F.col("outgoing") & (F.col("source") == node_id) & (F.col("target") == F.col("other"))) | (~F.col("outgoing") & (F.col("target") == node_id) & (F.col("source") == F.col("other"))))
    return near.join(nodes.select(F.col("id").alias("other"), "file_path"), "other", "left").select(paths.edge_label(F.col("type"), F.col("outgoing")).alias("label"), "other", "file_path")
