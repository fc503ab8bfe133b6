"""Imports of packages of the corpus: ``exports`` of their manifests, with conditions and wildcards.

Each ``package.json`` gives rows of subpaths: the target for imports and the one for
``require``, chosen by the first condition in the manifest's own order that applies. A
specifier meets its package by name; then its subpath by equality, or else the wildcard whose
text before the ``*`` is the longest prefix of it: the prefixes of subpaths are exploded and meet
these texts by equality. A manifest without ``exports`` gives its main fields, and any file
below its folder. The importing file's kind of import picks the target.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import paths

# Conditions that apply, and main fields, in order; ``require`` stands for ``import`` where a file is required.
CONDITIONS = ("source", "import", "node", "default")
MAIN_FIELDS = ("source", "module", "main")
_ROWS = "struct<name: string, open: boolean, rows: array<struct<subpath: string, imported: string, required: string>>>"


def target_of(value: object, conditions: tuple[str, ...]) -> str | None:
    """The target that an ``exports`` value means under conditions: the first key that applies and leads somewhere."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return next((t for t in (target_of(v, conditions) for v in value) if t is not None), None)
    if isinstance(value, dict):
        for key, inner in value.items():
            if key in conditions:
                found = target_of(inner, conditions)
                if found is not None or inner is None:
                    return found
    return None


def parsed_manifest(text: str | None) -> tuple[str | None, bool, list[tuple[str, str | None, str | None]]]:
    """(name, whether any file may be imported, (subpath, target, target of require)) of a package.json; targets below its folder only."""
    try:
        own = json.loads(text or "")
        name = own["name"]
    except (ValueError, KeyError, TypeError):
        return None, False, []
    if not isinstance(name, str):
        return None, False, []
    exports = own.get("exports")
    if exports is None:
        main = next((own[f] for f in MAIN_FIELDS if isinstance(own.get(f), str)), "./index")
        main = main if main.startswith("./") else "./" + main
        return name, True, [(".", main, main)]
    paths_ = exports if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else {".": exports}
    required = tuple("require" if c == "import" else c for c in CONDITIONS)
    rows = []
    for subpath, value in paths_.items():
        targets = [target_of(value, c) for c in (CONDITIONS, required)]
        rows.append((subpath, *(t if t is not None and t.startswith("./") and ".." not in t.split("/") else None for t in targets)))
    return name, False, rows


def exported(manifests: DataFrame) -> DataFrame:
    """(package, directory, open, subpath, head, tail, imported, required) of the manifests (path, text); ``tail`` is null without a wildcard."""
    parse = F.udf(lambda text: parsed_manifest(text), _ROWS)
    rows = manifests.where(paths.basename(F.col("path")) == "package.json").select(paths.dirname(F.col("path")).alias("directory"), parse("text").alias("m")).where("m.name IS NOT NULL")
    rows = rows.select(F.col("m.name").alias("package"), "directory", F.col("m.open").alias("open"), F.explode("m.rows").alias("r")).select("package", "directory", "open", "r.*")
    star = F.contains("subpath", F.lit("*"))
    return rows.select("*", F.when(star, F.substring_index("subpath", "*", 1)).otherwise(F.col("subpath")).alias("head"), F.when(star, F.substring_index("subpath", "*", -1)).alias("tail"))


def package_targets(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, specifier, target): where specifiers that begin with a package of the corpus lead, before suffixes are tried.

    ``rows``: path, specifier, required. Of packages of one name the one whose folder comes first counts.
    """
    from corpuscle.operators.kept import kept

    known = kept(exported(manifests))
    first = Window.partitionBy("package").orderBy(F.length("directory"), "directory")
    own = known.select("package", "directory", "open").distinct().withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    known = known.drop("open").join(own.select("package", "directory"), ["package", "directory"], "left_semi")
    bare = rows.where(~F.col("specifier").rlike(r"^(\.|/|#|[a-z]+:)"))
    parts = F.split("specifier", "/")
    package = F.when(F.startswith("specifier", F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    named = bare.withColumn("package", package).join(own, "package").withColumn("subpath", F.concat(F.lit("."), F.expr("substring(specifier, length(package) + 1)")))
    key = ["path", "specifier", "required"]
    chosen = F.when(F.col("required"), F.col("r")).otherwise(F.col("i")).alias("to")
    targets = known.select("package", "directory", F.col("subpath").alias("_subpath"), "head", "tail", F.col("imported").alias("i"), F.col("required").alias("r"))
    exact = named.join(targets.where("tail IS NULL").drop("head", "tail"), ["package", "directory"]).where("subpath = _subpath").select(*key, "directory", F.lit("").alias("held"), chosen)
    prefixes = F.transform(F.sequence(F.lit(1), F.length("subpath")), lambda n: F.substring(F.col("subpath"), F.lit(1), n))
    wide = named.select(*key, "package", "directory", "subpath", F.explode(prefixes).alias("head")).join(targets.where("tail IS NOT NULL"), ["package", "directory", "head"])
    fits = F.endswith("subpath", F.col("tail")) & (F.length("subpath") >= F.length("head") + F.length("tail") + 1)
    held = F.expr("substring(subpath, length(head) + 1, length(subpath) - length(head) - length(tail))")
    longest = Window.partitionBy(*key).orderBy(F.desc(F.length("head")), F.desc(F.length("_subpath")), "_subpath")
    wide = wide.where(fits).withColumn("_r", F.row_number().over(longest)).where("_r = 1").select(*key, "directory", held.alias("held"), chosen)
    wide = wide.join(exact.select(*key), key, "left_anti")
    inside = named.where("open AND subpath <> '.'").select(*key, "directory", F.lit("").alias("held"), F.col("subpath").alias("to"))
    found = exact.unionByName(wide).unionByName(inside).where("to IS NOT NULL")
    to = F.expr("substring(replace(to, '*', held), 3)")
    return found.select("path", "specifier", F.when(F.col("directory") == "", to).otherwise(F.concat_ws("/", "directory", to)).alias("target")).distinct()

