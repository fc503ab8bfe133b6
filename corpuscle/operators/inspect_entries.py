"""Where to begin reading: likely entries by centrality and path conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import fixed, paths

SHOWN, SURFACES = 8, 2


def _parts(p: Column) -> Column:
    return F.split(p, "/")


def score(p: Column, tags: Column, fan_in: Column, fan_out: Column) -> Column:
    """How useful a file is as a start; higher is better."""
    central, n, name = fan_in + fan_out, F.size(_parts(p)), F.lower(paths.basename(p))
    entry = F.array_contains(tags, "entry-candidate")
    shallow = (n <= 3) | ((name == "__main__.py") | F.array_contains(_parts(p), "src")) & (n <= 5)
    helper = F.contains(p, F.lit("/_api/"))
    penalty = F.when(name.isin(*fixed.UTILITY_BASENAMES), 60).when(F.contains(p, F.lit("/utils/")) | F.contains(p, F.lit("/load/import_map.")), 120).otherwise(0)
    return (
        F.least(central, F.lit(120))
        + F.when(entry, F.when(shallow, 80).otherwise(12)).otherwise(0)
        + F.when(paths.is_surface(p) & ~helper, 45 + F.least(central, F.lit(30))).otherwise(0)
        + F.when(name.isin(*fixed.IMPLEMENTATION_BASENAMES), 28).otherwise(0)
        - penalty
        - F.when((name == "app.py") & (n > 4), 24).otherwise(0)
        - F.when(helper, 80).otherwise(0)
    )


def role(p: Column, tags: Column, relations: Column) -> Column:
    """What a start is called."""
    name = F.lower(paths.basename(p))
    utility = name.isin(*fixed.UTILITY_BASENAMES) | F.contains(p, F.lit("/utils/")) | F.contains(p, F.lit("/load/import_map."))
    served = name.isin("server.py", "server.ts", "server.js") & F.exists(_parts(p), lambda x: x.isin("server", "gateway"))
    return (
        F.when(F.contains(p, F.lit("/_api/")), "support source")
        .when(paths.is_surface(p), "package surface")
        .when(name.isin("cli.py", "cli.ts", "cli.js", "run-main.ts", "run-main.js") | F.array_contains(_parts(p), "cli"), "cli entry")
        .when(served, "server entry")
        .when(name.isin(*fixed.IMPLEMENTATION_BASENAMES), "implementation surface")
        .when(F.array_contains(tags, "entry-candidate"), "entry file")
        .when(utility, "support source")
        .when(relations <= 1, "source file")
        .otherwise("high-centrality source")
    )


def likely_entries(nodes: DataFrame, edges: DataFrame, limit: int = SHOWN) -> DataFrame:
    """(file, score, role) of the best starts, at most two package surfaces unless others run out.

    Production code is preferred, then any code, then any file; generated files only where
    nothing else is.
    """
    files = nodes.where("line_start IS NULL")
    imports = edges.where("type = 'imports'")
    into = imports.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    out = imports.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    p = F.col("file_path")
    tier = F.when(paths.category(p) != "code", 2).when(paths.is_test(p), 1).otherwise(0) * 2 + paths.is_generated(p).cast("int")
    rows = files.join(into, "id", "left").join(out, "id", "left").select("file_path", "tags", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"), tier.alias("tier"))
    best = rows.agg(F.min("tier").alias("_best"))
    rows = rows.join(F.broadcast(best), F.col("tier") == F.col("_best"))
    scored = rows.select("file_path", score(p, F.col("tags"), F.col("fan_in"), F.col("fan_out")).alias("score"), role(p, F.col("tags"), F.col("fan_in") + F.col("fan_out")).alias("role"), paths.is_surface(p).alias("_surface"))
    order = [F.desc("score"), paths.depth(p), p]
    few = scored.where("_surface").orderBy(*order).limit(limit).unionByName(scored.where("NOT _surface").orderBy(*order).limit(limit))
    rank = F.row_number().over(Window.partitionBy("_surface").orderBy(*order))
    chosen = few.withColumn("_later", F.col("_surface") & (rank > SURFACES)).orderBy("_later", *order).limit(limit)
    return chosen.orderBy(*order).select(p.alias("file"), "score", "role")
