"""Path policy as Spark columns: what a path says about a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import fixed


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def parts(path: Column) -> Column:
    """Non-empty path segments, parted by slash or backslash."""
    return F.filter(F.split(path, r"[\\/]+"), lambda p: p != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """All before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The last dot of the base name and what follows; a leading dot alone is no suffix."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def ancestors(path: Column) -> Column:
    """Each directory above a path, the highest first, without the root."""
    names = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def within(path: Column, directory: Column) -> Column:
    """Whether a path is a directory or lies in it; the empty directory holds all."""
    return (directory == "") | (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def is_test(path: Column) -> Column:
    names = parts(F.lower(path))
    name = F.element_at(names, -1)

    def directory(p: Column) -> Column:
        return p.isin(*fixed.TEST_DIRS) | p.rlike(r"^test[-_]|[-_]tests?$")

    return F.exists(names, directory) | F.startswith(name, F.lit("test_")) | _any([F.contains(name, F.lit(m)) for m in fixed.TEST_FILE_MARKS])


def is_generated(path: Column) -> Column:
    names = parts(F.lower(path))
    name = F.element_at(names, -1)
    return _any([F.contains(name, F.lit(m)) for m in fixed.GENERATED_FILE_MARKS]) | name.isin(*fixed.GENERATED_NAMES) | F.exists(names, lambda p: p.isin(*fixed.GENERATED_DIRS))


def is_ignored(path: Column) -> Column:
    """Whether a path lies under an ignored directory, or a hidden one that isn't kept."""
    names = parts(F.lower(path))
    above = F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))
    anywhere = F.exists(above, lambda p: p.isin(*fixed.IGNORED_DIRS) | (F.startswith(p, F.lit(".")) & ~p.isin(*fixed.KEPT_HIDDEN_DIRS)))
    return anywhere | F.coalesce(F.get(above, F.lit(0)).isin(*fixed.ROOT_IGNORED_DIRS), F.lit(False))


def is_supported(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*fixed.PYTHON_SUFFIXES, *fixed.SCRIPT_SUFFIXES) & ~is_ignored(path)


def is_implementation(path: Column) -> Column:
    """Whether a path is of a programming language and not generated."""
    return F.lower(suffix(path)).isin(*fixed.PYTHON_SUFFIXES, *fixed.SCRIPT_SUFFIXES, *fixed.UNPARSED_SUFFIXES) & ~is_generated(path)


def is_scanned(path: Column) -> Column:
    """Whether discovery takes a file: names that always count, then suffixes that never do, then those that do."""
    kind = suffix(path)
    known = kind.isin(*fixed.PYTHON_SUFFIXES, *fixed.SCRIPT_SUFFIXES, *fixed.UNPARSED_SUFFIXES, *fixed.TEXT_SUFFIXES)
    return (basename(path).isin(*fixed.SCAN_BASENAMES) | (~kind.isin(*fixed.IGNORED_SUFFIXES) & known)) & ~is_ignored(path)


def language(path: Column) -> Column:
    """The language of a suffix, else the bare suffix, else ``unknown``."""
    table = F.create_map(*(F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair))
    kind = suffix(path)
    return F.coalesce(F.try_element_at(table, kind), F.nullif(F.regexp_replace(kind, r"^\.", ""), F.lit("")), F.lit("unknown"))


def category(path: Column) -> Column:
    """docs, config, infra, data or code; the first that fits."""
    low, name = F.lower(path), basename(path)
    return (
        F.when(low.rlike(r"\.(md|rst|txt)$"), "docs")
        .when(name.isin(*fixed.CONFIG_BASENAMES) | low.rlike(r"\.(json|toml|yaml|yml)$"), "config")
        .when(low.rlike(r"^(\.github|deploy|infra|infrastructure)/") | name.isin("Dockerfile", "docker-compose.yml"), "infra")
        .when(low.rlike(r"\.(csv|db|parquet|proto|graphql|prisma|sql)$"), "data")
        .otherwise("code")
    )


def node_type(path: Column, kind: Column, lang: Column) -> Column:
    """The graph's node type of a file, from its category and language."""
    low = F.lower(path)
    infra = F.when(low.rlike(r"\.github/workflows/|jenkinsfile"), "pipeline").when(low.rlike(r"\.(tf|tfvars)$"), "resource").otherwise("service")
    data = F.when(lang.isin("graphql", "protobuf", "prisma"), "schema").when(lang == "sql", "table").otherwise("file")
    return F.when(kind == "docs", "document").when(kind == "config", "config").when(kind == "infra", infra).when(kind == "data", data).otherwise("file")


def tags(path: Column, kind: Column, lang: Column) -> Column:
    """Sorted distinct tags of a file, without ``unknown``."""
    name = basename(path)
    found = F.array(
        kind,
        lang,
        F.when(is_test(path), "test"),
        F.when(name.isin("README.md", "readme.md"), "entry-documentation"),
        F.when(name.isin(*fixed.MANIFESTS), "project-manifest"),
        F.when(name.isin("Dockerfile", "docker-compose.yml") | F.contains(F.lower(path), F.lit(".github/workflows/")), "infrastructure"),
        F.when(F.lower(name).isin(*fixed.ENTRY_BASENAMES), "entry-candidate"),
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: t.isNotNull() & ~t.isin("", "unknown"))))


def is_surface(path: Column) -> Column:
    """Whether a file is its package's initialiser or index."""
    return F.lower(basename(path)).isin("__init__.py", "index.ts", "index.js")


def is_conventional_surface(path: Column) -> Column:
    return basename(path).rlike(r"^(__init__\.py|index\.[^.]+)$")


def surface_scope(path: Column) -> Column:
    """A surface's directory; any other file itself."""
    return F.when(is_conventional_surface(path), dirname(path)).otherwise(path)


def module_name(path: Column) -> Column:
    """The dotted name of a Python file."""
    return F.regexp_replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/", ".")


def relevance(path: Column, terms: list[str]) -> Column:
    """Where a path ranks for a query; lower is better."""
    low = F.lower(path)
    named = reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in terms], F.lit(0))
    return (
        F.when(F.startswith(low, F.lit("src/")), 0).otherwise(4)
        + F.when(is_test(path), 3).otherwise(0)
        + F.when(low.rlike(r"\.(md|json|yaml|yml|toml)$"), 5).otherwise(0)
        + F.when(is_generated(path), 8).otherwise(0)
        - 2 * F.least(named, F.lit(3))
    )


def edge_label(kind: Column, outgoing: Column) -> Column:
    """How an edge reads from the node at its one end."""
    return (
        F.when(kind == "imports", F.when(outgoing, "imports").otherwise("imported by"))
        .when(kind == "calls", F.when(outgoing, "calls").otherwise("called by"))
        .when(kind == "contains", F.when(outgoing, "contains").otherwise("in"))
        .otherwise(kind)
    )
