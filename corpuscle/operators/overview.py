"""What a summary names first: most called symbols, clusters, surfaces, related boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import fixed, paths, text

CLUSTER_CAP = 8000


def is_generic(name: Column) -> Column:
    """Whether a name, its last part without what follows in brackets, says nothing about structure."""
    last = F.substring_index(F.regexp_replace(name, r"\s+\(.*", ""), ".", -1)
    return F.startswith(last, F.lit("#")) | last.isin(*fixed.GENERIC_NAMES)


def most_called(calls: DataFrame) -> DataFrame:
    """(target, calls, share) of call edges (column target): generic names go, but count in the whole."""
    sums = calls.groupBy("target").agg(F.count("*").alias("calls"))
    whole = sums.agg(F.sum("calls").alias("_all"))
    return sums.crossJoin(F.broadcast(whole)).where(~is_generic(F.col("target"))).select("target", "calls", (F.col("calls") / F.col("_all")).alias("share"))


def common_owner(files: Column) -> Column:
    """The deepest directory that holds all of an array of paths; null above two parts."""
    folders = F.transform(files, lambda f: F.slice(F.split(f, "/"), F.lit(1), F.size(F.split(f, "/")) - 1))
    first = F.get(folders, F.lit(0))
    depths = F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1)))
    shared = F.filter(depths, lambda n: (n <= F.size(first)) & F.forall(folders, lambda x: F.slice(x, F.lit(1), n) == F.slice(first, F.lit(1), n)))
    deepest = F.coalesce(F.array_max(shared), F.lit(0))
    return F.when(deepest > 1, F.array_join(F.slice(first, F.lit(1), F.greatest(deepest, F.lit(1))), "/"))


def is_project_wide(label: Column, root: str) -> Column:
    """Whether a label only repeats the end of the corpus's own path, its parts joined by hyphens."""
    names = [p.lower().lstrip(".") for p in root.replace("\\", "/").split("/")]
    names = [p for p in names if p]
    return F.lower(label).isin(*("-".join(names[i:]) for i in range(len(names)))) if names else F.lit(False)


def cluster_labels(clusters: DataFrame, root: str = "") -> DataFrame:
    """``clusters`` (cluster, label, names, files, members) with the label to show and the share of symbols.

    The common owner of the files, else the label unless it is the corpus's own, else the first
    name that isn't generic. Labels that repeat, or say nothing, get that name as a suffix.
    """
    named = clusters.where(F.col("label").isNull() | ~F.coalesce(paths.is_test(F.col("label")), F.lit(False)))
    anchor = F.get(F.filter("names", lambda n: ~is_generic(n)), F.lit(0))
    own = F.when(~is_project_wide(F.col("label"), root), F.col("label"))
    rows = named.select("cluster", "members", anchor.alias("_anchor"), F.coalesce(common_owner(F.col("files")), own, anchor, F.lit("cluster")).alias("label"))
    again = rows.groupBy("label").agg(F.count("*").alias("_n"))
    symbols = clusters.agg(F.least(F.lit(CLUSTER_CAP), F.sum("members")).alias("_all"))
    joined = rows.join(again, "label").crossJoin(F.broadcast(symbols))
    suffixed = F.col("_anchor").isNotNull() & ((F.col("_n") > 1) | F.lower("label").isin(*fixed.GENERIC_LABELS))
    shown = F.when(suffixed, F.concat("label", F.lit(" — "), "_anchor")).otherwise(F.col("label"))
    return joined.select("cluster", shown.alias("label"), F.try_divide(F.col("members"), F.col("_all")).alias("share"))


def export_groups(exports: DataFrame) -> DataFrame:
    """(file, origin, names, first): the names a surface shows, by the module that defines them, in order of discovery."""
    rows = exports.groupBy("file", "origin", "name").agg(F.min("ord").alias("ord"))
    return rows.groupBy("file", "origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"), F.min("ord").alias("first"))


def depth_below(file: Column, focus: Column) -> Column:
    """Parts of a path below a directory."""
    return paths.depth(file) - F.when(focus == "", 0).otherwise(paths.depth(focus))


def surface_winners(candidates: DataFrame, focus: DataFrame) -> DataFrame:
    """(file, ord): surfaces to show, of candidates (file, declared, fan_in, origins, names) and focus (ord, focus).

    Within each focus three win: the entry (shallowest, conventional, declared), the most
    imported if any imports it, and the broadest near the top (at most one part deeper than
    the shallowest). A file counts where it first wins. Candidates meet the focus directories
    above them by equality.
    """
    above = candidates.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit(""), F.col("file")), paths.ancestors(F.col("file"))))).alias("focus"))
    scoped = above.join(F.broadcast(focus.limit(FOCUS_LIMIT)), "focus").withColumn("_below", depth_below(F.col("file"), F.col("focus")))
    plain, loose, deep = ~paths.is_conventional_surface(F.col("file")), ~F.col("declared"), paths.depth(F.col("file"))
    own = Window.partitionBy("ord")
    entry = F.row_number().over(own.orderBy("_below", plain, loose, "file"))
    central = F.row_number().over(own.orderBy(F.desc("fan_in"), loose, deep, "file"))
    near = F.col("_below") <= F.min("_below").over(own) + 1
    broad = F.row_number().over(own.orderBy(F.desc(near), F.desc("origins"), F.desc("names"), loose, deep, "file"))
    ranked = scoped.select("file", "ord", "fan_in", entry.alias("_e"), central.alias("_c"), broad.alias("_b"))
    kind = F.when(F.col("_e") == 1, 0).when((F.col("_c") == 1) & (F.col("fan_in") > 0), 1).when(F.col("_b") == 1, 2)
    won = ranked.select("file", F.struct("ord", kind.alias("kind")).alias("at"), kind.alias("_k")).where("_k IS NOT NULL")
    return won.groupBy("file").agg(F.min("at").alias("at")).select("file", "at.ord", "at.kind")


#: Directories in focus: a few for each role; a broadcast of so many short rows.
FOCUS_LIMIT = 10_000


def sampled_roots(packages: DataFrame) -> DataFrame:
    """(root): first, middle and last package of each family of siblings; a package at the top stands for itself."""
    rows = packages.select("root").distinct()
    families = rows.where("root <> ''").groupBy(paths.dirname(F.col("root")).alias("parent")).agg(F.sort_array(F.collect_set("root")).alias("roots"))
    return rows.where("root = ''").unionByName(families.select(F.explode(text.extent_sample(F.col("roots"))).alias("root"))).distinct()


def compacted_references(edges: DataFrame, end: str, packages: bool = True) -> DataFrame:
    """(node, label, n, examples): for each node the boundaries at the ``end`` of its edges, one big family as a group.

    ``edges``: node, other. The family is the parent directory of more than three others and
    of more than half of them (at the target end also two parts deep); it reads ``parent/*``.
    Repeated references count once.
    """
    rows = edges.select("node", "other").distinct().withColumn("parent", paths.dirname(F.col("other")))
    sizes = rows.where("parent <> ''").groupBy("node", "parent").agg(F.count("*").alias("n"))
    whole = rows.groupBy("node").agg(F.count("*").alias("_all"))
    big = sizes.join(whole, "node").where("n > 3 AND 2 * n > _all")
    if end == "target":
        big = big.where(paths.depth(F.col("parent")) >= 2)
    chosen = big.groupBy("node").agg(F.max_by("parent", F.struct("n", "parent")).alias("_family"))  # a majority is one
    joined = rows.join(chosen, "node", "left").withColumn("_in", F.coalesce(F.col("parent") == F.col("_family"), F.lit(False)))
    label = F.when(F.col("_in"), F.concat("_family", F.lit("/*"))).otherwise(F.col("other"))
    member = F.when(F.col("_in"), F.substring_index("other", "/", -1))
    grouped = joined.groupBy("node", label.alias("label")).agg(F.count_if("_in").alias("n"), text.extent_sample(F.sort_array(F.collect_set(member))).alias("examples"))
    return grouped.select("node", "label", F.nullif("n", F.lit(0)).alias("n"), "examples")


def package_edges(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(source, target, weight) between packages (root, name) whose manifests (root, dependency) name one another."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[_.]+", "-")
    named = packages.where("name <> ''").select(plain(F.col("name")).alias("_n"), F.col("root").alias("target"))
    rows = dependencies.select(plain(F.col("dependency")).alias("_n"), F.col("root").alias("source")).join(named, "_n").where("source <> target")
    return rows.groupBy("source", "target").agg(F.lit(1).cast("long").alias("weight"))


def added_weights(*edges: DataFrame) -> DataFrame:
    """(source, target, weight): relations of several lanes, weights of one pair added."""
    rows = edges[0].select("source", "target", "weight")
    for more in edges[1:]:
        rows = rows.unionByName(more.select("source", "target", "weight"))
    return rows.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def has_evidence(*tables: DataFrame) -> bool:
    """Whether any table has a row."""
    return any(not t.isEmpty() for t in tables)
