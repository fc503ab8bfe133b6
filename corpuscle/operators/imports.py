"""Imports resolved to files: candidate paths with priorities, joined by equality."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import fixed, paths
from corpuscle.operators import packages

#: Suffixes that a script import without one may mean, in order; and those that a written one may stand for.
GUESSES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
ALIASES = {".js": (".ts", ".tsx", ".js", ".jsx"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs", ".cts", ".cjs"), ".cjs": (".cts", ".cjs", ".mts", ".mjs")}


def module_index(files: DataFrame) -> DataFrame:
    """(module, path): dotted names of Python files below the top packages, without what stands above these.

    A top package has an initialiser and its parent has none.
    """
    packages = files.where(paths.basename(F.col("path")) == "__init__.py").select(paths.dirname(F.col("path")).alias("package")).distinct()
    parents = packages.select(F.col("package").alias("_p"))
    tops = packages.withColumn("_p", paths.dirname(F.col("package"))).join(parents, "_p", "left_anti").select("package")
    python = files.where(F.endswith("path", F.lit(".py"))).select("path", F.explode(F.concat(paths.ancestors(F.col("path")), F.array(F.lit("")))).alias("package"))
    inside = python.join(tops.where("package <> ''"), "package").withColumn("_at", F.length(paths.dirname(F.col("package"))))
    relative = F.when(F.col("_at") == 0, F.col("path")).otherwise(F.expr("substring(path, _at + 2)"))
    return inside.select(paths.module_name(relative).alias("module"), "path").dropDuplicates(["module", "path"])


def python_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target, name): local files that Python imports mean.

    ``import a.b`` means a/b.py or a/b/__init__.py, else the module of that name below a top
    package. ``from p import n`` means the module p.n where any such resolves, else p. Levels
    climb from the file's directory.
    """
    rows = facts.where("kind IN ('import', 'from') AND path LIKE '%.py'").select("path", "kind", "name", F.col("identifier").alias("module"), F.col("detail").cast("int").alias("level"), F.struct("path", "line", "kind", "name", "identifier", "detail").alias("_id"))
    base = F.split(paths.dirname(F.col("path")), "/")
    depth = F.size(F.filter(base, lambda x: x != ""))
    above = F.array_join(F.slice(F.filter(base, lambda x: x != ""), F.lit(1), F.greatest(depth - F.col("level") + 1, F.lit(0))), "/")
    dotted = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    root = F.when(F.col("level") > 0, F.concat_ws("/", F.nullif(above, F.lit("")), F.nullif(dotted, F.lit("")))).otherwise(dotted)
    sub = F.when((F.col("kind") == "from") & (F.col("name") != "*"), F.concat_ws("/", F.nullif(root, F.lit("")), "name"))
    rows = rows.withColumn("_root", root).withColumn("_sub", sub)
    options = F.filter(
        F.array(*(F.struct(F.lit(i).alias("rank"), F.concat(c, F.lit(tail)).alias("target")) for i, (c, tail) in enumerate(((F.col("_sub"), ".py"), (F.col("_sub"), "/__init__.py"), (F.col("_root"), ".py"), (F.col("_root"), "/__init__.py"))))),
        lambda x: x["target"].isNotNull(),
    )
    direct = rows.select("_id", "path", "name", F.explode(options).alias("o")).select("_id", "path", "name", "o.rank", "o.target").join(files.select(F.col("path").alias("target")), "target")
    index = module_index(files)
    names = F.filter(F.array(F.struct(F.lit(4).alias("rank"), F.when(F.col("kind") == "from", F.concat_ws(".", "module", "name")).alias("module")), F.struct(F.lit(5).alias("rank"), F.col("module").alias("module"))), lambda x: x["module"].isNotNull())
    named = rows.where("level = 0").select("_id", "path", "name", F.explode(names).alias("o")).select("_id", "path", "name", "o.rank", "o.module").join(index.withColumnRenamed("path", "target"), "module").drop("module")
    found = direct.select("_id", "path", "name", "rank", "target").unionByName(named)
    best = found.groupBy("_id", "path", "name").agg(F.min(F.struct("rank", "target")).alias("b"))
    return best.select(F.col("path").alias("source"), "b.target", "name").where("source <> target").distinct()


def parsed_config(path: str, text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(the config that it rests on as written from the root, or None; (pattern, replacement from the root) of its own ``paths``) of a tsconfig.

    Comments and trailing commas are allowed; a config with ``paths`` rests on no other.
    """
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text or "")
    try:
        own = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))
    except ValueError:
        return None, []
    options = own.get("compilerOptions") or {}
    if "paths" in options or not isinstance(own.get("extends"), str):
        base = posixpath.normpath(posixpath.join(posixpath.dirname(path), options.get("baseUrl") or "."))
        return None, [(pattern, posixpath.normpath(posixpath.join(base, target))) for pattern, targets in (options.get("paths") or {}).items() for target in targets]
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), own["extends"])), []


def aliases(configs: DataFrame) -> DataFrame:
    """(directory, table): of each directory whose configs have ``paths``, the (pattern, replacement) in order; ``configs``: path, text.

    Configs are parsed in executors. ``extends`` of a relative path is followed, a step of all
    chains in each round; a ring ends without ``paths``.
    """
    parse = F.udf(parsed_config, "struct<rests: string, table: array<struct<pattern: string, target: string>>>")
    each = configs.select("path", parse("path", "text").alias("c")).select("path", "c.rests", "c.table").persist()
    named = paths.basename(F.col("path")).isin("tsconfig.json", "jsconfig.json")
    at = each.where(named).select(F.col("path").alias("config"), "rests", "table", F.array("path").alias("seen"))
    ends = at.where("rests IS NULL")
    at = at.where("rests IS NOT NULL")
    while not at.isEmpty():
        tries = at.select("config", "seen", F.posexplode(F.array(F.col("rests"), F.concat("rests", F.lit(".json")))).alias("no", "path")).join(each, "path")
        first = tries.groupBy("config", "seen").agg(F.min_by(F.struct("path", "rests", "table"), "no").alias("f")).where(~F.array_contains("seen", F.col("f.path")))
        step = first.select("config", "f.rests", "f.table", F.concat("seen", F.array("f.path")).alias("seen")).persist()
        ends, at = ends.unionByName(step.where("rests IS NULL")), step.where("rests IS NOT NULL")
    rows = ends.where("size(table) > 0").groupBy(paths.dirname(F.col("config")).alias("directory")).agg(F.sort_array(F.collect_list(F.struct("config", "table"))).alias("t"))
    return rows.select("directory", F.flatten("t.table").alias("table"))


def script_imports(facts: DataFrame, files: DataFrame, configs: DataFrame | dict[str, str] | None = None, manifests: DataFrame | None = None) -> DataFrame:
    """(source, target, name): local files that script imports and re-exports mean.

    Relative specifiers are normalised; others go through the nearest config's aliases, then
    to packages of the corpus by ``manifests`` (path, text of package.json files). The
    first candidate that exists wins: as written, with the suffixes it may stand for, with
    guessed suffixes, as a folder's index. ``configs``: path, text, or texts by path.
    """

    def candidates(path: str, specifier: str, table: list, package: list) -> list[str]:
        if specifier.startswith("."):
            bases = [posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))]
        else:
            bases = []
            for pattern, target in sorted(table or (), key=lambda x: -len(x[0])):
                head, star, tail = pattern.partition("*")
                if specifier == pattern if not star else specifier.startswith(head) and specifier.endswith(tail):
                    bases.append(target.replace("*", specifier[len(head) : len(specifier) - len(tail)]) if star else target)
        out = []
        for base in [*bases, *(package or ())]:
            stem, suffix = posixpath.splitext(base)
            out += [base, *(stem + s for s in ALIASES.get(suffix, ())), *(base + s for s in GUESSES), *(f"{base}/index{s}" for s in GUESSES)]
        return out

    rows = facts.where("kind IN ('import', 'reexport')").where(F.lower(paths.suffix(F.col("path"))).isin(*fixed.SCRIPT_SUFFIXES))
    required = rows.select("path", F.col("identifier").alias("specifier"), (F.col("detail") == "require").alias("required")).distinct()
    rows = required.select("path", "specifier").distinct()
    if isinstance(configs, dict):
        configs = facts.sparkSession.createDataFrame(list(configs.items()), "path string, text string")
    if configs is None:
        rows = rows.withColumn("table", F.lit(None).cast("array<struct<pattern: string, target: string>>"))
    else:
        table = aliases(configs)
        above = rows.where(~F.startswith("specifier", F.lit("."))).select("path").distinct().select("path", F.explode(F.array_distinct(F.concat(paths.ancestors(F.col("path")), F.array(F.lit(""))))).alias("directory"))
        near = above.join(table.select("directory"), "directory").groupBy("path").agg(F.max_by("directory", F.length("directory")).alias("directory"))
        rows = rows.join(near, "path", "left").join(table, "directory", "left").drop("directory")

    if manifests is None:
        rows = rows.withColumn("package", F.lit(None).cast("array<string>"))
    else:
        led = packages.package_targets(required, manifests).groupBy("path", "specifier").agg(F.sort_array(F.collect_list("target")).alias("package"))
        rows = rows.join(led, ["path", "specifier"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, s, rank, target) for p, s, t, k in zip(*(c.to_pylist() for c in batch.columns), strict=True) for rank, target in enumerate(candidates(p, s, [(x["pattern"], x["target"]) for x in t or ()], k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["path", "specifier", "rank", "target"])

    rows = rows.select("path", "specifier", "table", "package").mapInArrow(run, "path string, specifier string, rank int, target string")
    best = rows.join(files.select(F.col("path").alias("target")), "target").groupBy("path", "specifier").agg(F.min(F.struct("rank", "target")).alias("b"))
    return best.select(F.col("path").alias("source"), "b.target", F.col("specifier").alias("name")).where("source <> target").distinct()


def import_map(facts: DataFrame, files: DataFrame, configs: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """(source, target): all resolved imports of the inventory."""
    both = python_imports(facts, files).select("source", "target").unionByName(script_imports(facts, files, configs).select("source", "target"))
    return both.distinct()


def nodes_and_edges(files: DataFrame, facts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph: nodes of files, functions and classes; edges imports, contains and calls.

    ``files``: path, n_lines. Calls join only where caller and callee are functions of one
    file. Edges are distinct.
    """
    p, lang = F.col("path"), paths.language(F.col("path"))
    kind = paths.category(p)
    counts = facts.groupBy("path").agg(F.count_if(F.col("kind") == "function").alias("_f"), F.count_if(F.col("kind") == "class").alias("_c"))
    targets = resolved.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("_i"))
    rows = files.join(counts, "path", "left").join(targets, "path", "left")
    held = F.concat_ws(", ", F.when(F.col("_f") > 0, F.concat("_f", F.lit(" functions"))), F.when(F.col("_c") > 0, F.concat("_c", F.lit(" classes"))))
    about = F.concat(p, F.lit(": "), F.concat_ws("; ", F.concat(kind, F.lit(" file in "), lang), F.concat(F.col("n_lines"), F.lit(" lines")), F.nullif(held, F.lit("")), F.when(F.col("_i") > 0, F.concat(F.lit("imports "), "_i", F.lit(" project files")))), F.lit("."))
    file_type = paths.node_type(p, kind, lang)
    file_nodes = rows.select(F.concat(file_type, F.lit(":"), p).alias("id"), file_type.alias("type"), paths.basename(p).alias("name"), p.alias("file_path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), about.alias("summary"), paths.tags(p, kind, lang).alias("tags"))
    defs = facts.where("kind IN ('function', 'class')").dropDuplicates(["path", "kind", "name"])
    def_nodes = defs.select(F.concat_ws(":", "kind", "path", "name").alias("id"), F.col("kind").alias("type"), "name", F.col("path").alias("file_path"), F.col("line").alias("line_start"), (F.col("line") + F.col("span") - 1).alias("line_end"), F.concat("kind", F.lit(" "), "name").alias("summary"), F.array("kind").alias("tags"))
    ids = file_nodes.select(F.col("file_path").alias("_path"), F.col("id").alias("_id"))
    imports = resolved.join(ids.withColumnsRenamed({"_path": "source", "_id": "_s"}), "source").join(ids.withColumnsRenamed({"_path": "target", "_id": "_t"}), "target").select(F.col("_s").alias("source"), F.col("_t").alias("target"), F.lit("imports").alias("type"))
    contains = def_nodes.join(ids, F.col("file_path") == F.col("_path")).select(F.col("_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"))
    functions = def_nodes.where("type = 'function'").select("id")
    calls = facts.where("kind = 'call'").select(F.concat_ws(":", F.lit("function"), "path", "owner").alias("source"), F.concat_ws(":", F.lit("function"), "path", "name").alias("target"), F.lit("calls").alias("type"))
    calls = calls.join(functions.withColumnRenamed("id", "source"), "source", "left_semi").join(functions.withColumnRenamed("id", "target"), "target", "left_semi")
    edges = imports.unionByName(contains).unionByName(calls.select("source", "target", "type")).distinct()
    return file_nodes.unionByName(def_nodes), edges.withColumn("weight", F.lit(1).cast("long"))


def export_closure(facts: DataFrame, files: DataFrame, resolved: DataFrame, surface: str, cut=None) -> DataFrame:
    """(name, origin): public names of a file, followed through re-exports to where they are defined.

    ``resolved``: source, target, name of script imports. Names exported by the file itself
    come before those of ``export *``; a name whose module isn't local keeps its specifier.
    Each round follows one step, until no new file is reached; files once visited aren't visited
    again, so rings end. ``cut`` materialises a round; without it chains should be short.
    """
    steps = facts.where("kind = 'reexport'").select("path", F.col("name").alias("public"), F.col("identifier").alias("specifier"), F.col("detail").alias("imported"))
    steps = steps.join(resolved.select(F.col("source").alias("path"), F.col("name").alias("specifier"), "target"), ["path", "specifier"], "left")
    own = facts.where("kind = 'export'").select("path", F.col("name").alias("public"))
    plain = own.join(steps.where("imported <> '*'").select("path", "public"), ["path", "public"], "left_anti")
    spark = facts.sparkSession
    frontier = spark.createDataFrame([(surface, None, None)], "path string, wanted string, public string")
    seen, found = frontier.select("path", "wanted"), None
    for hop in count():
        named = F.col("wanted").isNull() | (F.col("wanted") == F.col("p"))
        here = frontier.join(plain.select("path", F.col("public").alias("p")), "path").where(named).select(F.coalesce("public", "p").alias("name"), F.col("path").alias("origin"), F.lit(2 * hop).alias("rank"))
        through = frontier.join(steps.select("path", F.col("public").alias("p"), "specifier", "imported", "target"), "path").where(named | (F.col("imported") == "*"))
        lost = through.where("target IS NULL AND imported <> '*'").select(F.coalesce("public", "p").alias("name"), F.col("specifier").alias("origin"), F.lit(2 * hop).alias("rank"))
        found = here.union(lost) if found is None else found.union(here).union(lost)
        star = F.col("imported") == "*"
        frontier = through.where("target IS NOT NULL").select(F.col("target").alias("path"), F.when(star, F.col("wanted")).otherwise(F.col("imported")).alias("wanted"), F.when(star, F.col("public")).otherwise(F.coalesce("public", "p")).alias("public")).distinct()
        frontier = frontier.join(seen, (frontier.path == seen.path) & frontier.wanted.eqNullSafe(seen.wanted), "left_anti")
        if cut is not None:
            frontier, found = cut(frontier), cut(found)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("path", "wanted"))
    return found.groupBy("name").agg(F.min(F.struct("rank", "origin")).alias("b")).select("name", "b.origin")
