"""The engine: questions over a corpus of files, as lazy DataFrames and rendered answers."""

from __future__ import annotations

import re
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import paths, render, text
from corpuscle.operators import facts as fact_rows
from corpuscle.operators import definitions, graph, imports, inspect_entries, match, overview, search, semantic, stats, trees
from corpuscle.operators import profiles as profile_rows
from corpuscle.operators import surfaces as surface_rows
from corpuscle.sources import files as file_source

SECTIONS = ("all", "top", "files", "functions", "variables", "usage", "lengths", "relationships", "docstrings", "stats")


class Engine:
    """One corpus (``files``: path, text), its fact tables computed once and kept."""

    def __init__(self, files: DataFrame, include_tests: bool = False):
        self.spark, self.files, self.include_tests = files.sparkSession, files.select("path", "text"), include_tests
        self._kept: dict[str, DataFrame] = {}
        self._indexes: dict[str, Any] = {}

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> Engine:
        files = file_source.read_files(spark, root).persist()  # discovery and ignore rules run once
        engine = cls(files, **options)
        engine._kept["read"] = files
        return engine

    def _keep(self, name: str, make, cut: bool = False) -> DataFrame:
        """What ``make`` gives, kept by its name; ``cut`` also ends its plan, where many others build on it."""
        if name not in self._kept:
            self._kept[name] = self._materialised(make()) if cut else make().persist()
        return self._kept[name]

    def _materialised(self, df: DataFrame) -> DataFrame:
        """``df``, computed and cut from its plan where the session has a checkpoint folder, else kept."""
        sc = self.spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            folder = self.spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp() if sc.master.startswith("local") and "cluster" not in sc.master else None)
            if folder:
                sc.setCheckpointDir(folder)
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return df.checkpoint()
        name = f"round {len(self._kept)}"
        self._keep(name, lambda: df).count()
        return self._kept[name]

    def refresh(self) -> None:
        """Drop the snapshot; the next question computes it anew."""
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()
        self._indexes.clear()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *error) -> None:
        self.refresh()

    @property
    def inventory(self) -> DataFrame:
        return self._keep("inventory", lambda: file_source.inventory(self.files))

    @property
    def facts(self) -> DataFrame:
        return self._keep("facts", lambda: fact_rows.facts(self.files))

    @property
    def docs(self) -> DataFrame:
        return self._keep("docs", lambda: fact_rows.documentation(self.files))

    @property
    def resolved(self) -> DataFrame:
        def make() -> DataFrame:
            some = self.files.where(F.col("path").rlike(r"(^|/)(ts|js)config[^/]*\.json$|(^|/)config/[^/]*\.json$"))
            manifests = self.files.where(paths.basename(F.col("path")) == "package.json")
            both = imports.python_imports(self.facts, self.inventory).unionByName(imports.script_imports(self.facts, self.inventory, some, manifests))
            return both

        return self._keep("resolved", make, cut=True)

    @property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        pairs = self.resolved.select("source", "target").distinct()
        return imports.nodes_and_edges(self.inventory, self.facts, pairs)

    @property
    def nodes(self) -> DataFrame:
        return self._keep("nodes", lambda: self._graph[0], cut=True)

    @property
    def edges(self) -> DataFrame:
        return self._keep("edges", lambda: self._graph[1], cut=True)

    def _production(self, rows: DataFrame, path: str = "path") -> DataFrame:
        """Rows of files that aren't generated, nor tests unless these are asked for."""
        p = F.col(path)
        return rows.where(~F.coalesce(paths.is_generated(p), F.lit(False)) & (F.lit(self.include_tests) | ~F.coalesce(paths.is_test(p), F.lit(False))))

    def search(self, query: str, lane: str = "source", limit: int = 15, **filters: Any) -> list[dict]:
        """The first lane that answers: path, definition, term coverage, exact text, concept paths."""
        if lane == "graph":
            return self.search_graph(query, limit, **filters)
        if lane == "semantic":
            return self.search_semantic(query, limit)
        files = self._production(self.files)
        if "/" in query or re.search(r"\.\w+$", query) and " " not in query:
            found = search.path_matches(files, query).orderBy("exactness", "path").limit(limit).collect()
            if found:
                return [{"lane": "path", "path": r.path} for r in found]
        symbols = text.definition_symbols(query) if "." not in query else []
        if symbols:
            phrase = symbols != [query]
            rows = definitions.symbol_definitions(files, self.facts, symbols, callable_only=phrase, include_tests=self.include_tests)
            rows = rows.withColumn("rank", search.match_rank(F.col("path"), F.col("text"), query, F.lit(True)))
            found = rows.orderBy("rank", "path", "line").limit(limit).collect()
            if found:
                return [{"lane": "definition", "path": r.path, "line": r.line, "text": r.text} for r in found]
        if re.fullmatch(r"[A-Za-z_$][\w$]*\.[A-Za-z_$][\w$]*", query):
            owner, name = query.split(".")
            found = fact_rows.members(self.facts.join(files.select("path"), "path", "left_semi"), owner).where(F.col("name") == name).orderBy("path", "line").limit(limit).collect()
            if found:
                return [{"lane": "member", "path": r.path, "line": r.line} for r in found]
        terms = text.query_terms(query)
        source = files.where(paths.is_implementation(F.col("path")))
        pool = source if terms and not search.coverage(source, query).isEmpty() else files
        if terms:
            whole = search.decisive(pool, query)
            ranked = search.ranked_coverage(pool, query)
            if whole:
                ranked = ranked.where(F.col("path").isin(whole))
            found = ranked.limit(min(limit, 8 if len(terms) > 1 else 2)).collect()
            if found and (whole or len(terms) == 1 or found[0].matched == len(terms)):
                return [{"lane": "coverage", "path": r.path, "terms": r.matched, "start": r.start, "end": r.end, "decisive": bool(whole)} for r in found]
        rows = search.literal_matches(files, query).withColumn("rank", search.match_rank(F.col("path"), F.col("text"), query, F.lit(False)))
        exact = rows.orderBy("rank", "path", "line", "col").limit(limit).collect()
        if exact:
            return [{"lane": "text", "path": r.path, "line": r.line, "col": r.col, "text": r.text} for r in exact]
        named = search.concept_paths(files, query).limit(limit).collect()
        if named:
            return [{"lane": "concept", "path": r.path} for r in named]
        return [{"lane": "partial", "path": r.path, "terms": r.matched} for r in found] if terms else []

    def search_graph(self, query: str, limit: int = 15, label: str | None = None, name_pattern: str | None = None, qn_pattern: str | None = None, file_pattern: str | None = None, relationship: str | None = None, min_degree: int | None = None, max_degree: int | None = None, exclude_entry_points: bool = False, offset: int = 0) -> list[dict]:
        """Nodes ranked by what they and their edges say, filtered by name, degree and relationship."""
        nodes = self.nodes if self.include_tests else self.nodes.where(~paths.is_test(F.col("file_path")))
        degree = graph.degrees(self.edges.select("source", "target")).withColumnRenamed("node", "id")
        keep = text.text_filter(F.col("name"), name_pattern) & text.text_filter(F.concat_ws(":", "file_path", "name"), qn_pattern) & text.glob_filter(F.col("file_path"), file_pattern)
        rows = nodes.where(keep).join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        if label is not None:
            rows = rows.where(F.lower("type") == label.lower())
        if min_degree is not None:
            rows = rows.where(F.col("degree") >= min_degree)
        if max_degree is not None:
            rows = rows.where(F.col("degree") <= max_degree)
        if exclude_entry_points:
            rows = rows.where(~F.exists("tags", lambda t: t.startswith("entry-")))
        if relationship is not None:
            rows = rows.join(graph.adjacency(self.edges.where(F.col("type") == relationship)).select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        found = graph.search_nodes(rows, self.edges, query).orderBy(F.desc("score"), "file_path", "id").offset(offset).limit(limit)
        return [r.asDict() for r in found.collect()]

    def search_semantic(self, query: str, limit: int = 15) -> list[dict]:
        """Symbols whose names and documentation are close to the query's keywords: cosine of hashed term vectors, 0.5 or more."""
        terms = text.search_terms(query)
        if not terms:
            return []
        if "semantic" not in self._indexes:
            rows = self.docs.where("kind <> 'file'").select(F.concat_ws(":", "path", "qualified_name").alias("id"), F.concat_ws(" ", "qualified_name", F.coalesce("docstring", F.lit(""))).alias("body"))
            self._indexes["semantic"] = semantic.semantic_lists(rows, text.identifier_tokens(F.col("body")), self._materialised)
        found = self._indexes["semantic"].search(terms).orderBy(F.desc("score"), "id").limit(limit)
        return [r.asDict() for r in found.collect()]

    def search_words(self, query: str, limit: int = 15) -> list[dict]:
        """Symbols ranked by BM25 over the parts of their names and documentation."""
        rows = self.docs.where("kind <> 'file'").select(F.concat_ws(":", "path", "qualified_name").alias("id"), F.concat_ws(" ", "qualified_name", F.coalesce("docstring", F.lit(""))).alias("body"))
        terms = text.search_terms(query)[:8]
        if not terms:
            return []
        found = graph.bm25(rows, terms, text.identifier_tokens(F.col("body"))).orderBy(F.desc("score"), "id").limit(limit)
        return [r.asDict() for r in found.collect()]

    def calls(self, name: str, limit: int = 1000) -> list[dict]:
        """Call sites of a name; a dotted one matches whole."""
        column = F.col("detail") if "." in name else F.col("name")
        rows = self.facts.where(F.col("kind").isin("call", "top_call") & (column == name)).select("path", "line", "owner", "detail").distinct()
        total = rows.count()
        return [r.asDict() | {"total": total} for r in rows.orderBy("path", "line", "detail").limit(limit).collect()]

    def match(self, pattern: str, language: str | None = None, limit: int = 1000) -> list[dict]:
        """Places where the tokens of a pattern stand; $X takes one token or bracket, $$$X any number."""
        rows = match.matches(self.files, pattern, language)
        return [r.asDict() for r in rows.orderBy("path", "line", "col").limit(limit).collect()]

    def rule(self, rule_text: str, limit: int = 1000) -> list[dict]:
        """Matches of a rule file; ``trees`` has the keys of rules. ``utils`` are rules by name, ``constraints`` bind metavariables."""
        rule = file_source.rule_file(rule_text)
        if rule["rule"].keys() == {"pattern"} and not rule.get("constraints"):
            return self.match(str(rule["rule"]["pattern"]), rule["language"], limit)
        rows = trees.rule_matches(self.files, rule["rule"], rule["language"], rule.get("utils"), rule.get("constraints"))
        return [r.asDict() for r in rows.orderBy("path", "line", "col").limit(limit).collect()]

    def profiles(self) -> DataFrame:
        p = F.col("path")
        inventory = self._production(self.inventory)
        pairs = self.resolved.select("source", "target").distinct().withColumn("type", F.lit("imports"))
        reexports = self.resolved.join(self.facts.where("kind = 'reexport'").select(p.alias("source"), F.col("identifier").alias("name")).distinct(), ["source", "name"], "left_semi").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("reexports_local"))
        rows = fact_rows.profiles(self.facts.join(inventory.select("path"), "path", "left_semi"), pairs, inventory.where("category = 'code'"))
        rows = rows.join(reexports, "file", "left").withColumn("reexports_local", F.coalesce("reexports_local", F.lit(0)))
        entry = F.array_contains(paths.tags(F.col("file"), F.lit("code"), F.lit("x")), "entry-candidate")
        return rows.withColumn("entry", entry).withColumn("role", fact_rows.role()).withColumn("score", fact_rows.score()).drop("entry")

    def mentions(self) -> DataFrame:
        """(language, name, n): identifiers over all files of a scanned language, tests too."""
        lang = F.when(F.endswith("path", F.lit(".py")), "python").otherwise("typescript")
        rows = self.files.where(F.lower(paths.suffix(F.col("path"))).isin(".py", *_SCRIPTS)).select(lang.alias("language"), F.explode(F.regexp_extract_all("text", F.lit(text.IDENTIFIER), F.lit(0))).alias("name"))
        return rows.groupBy("language", "name").agg(F.count("*").alias("mentions"))

    def definitions(self, kind: str) -> DataFrame:
        """Functions or variables with lines and mentions; the longest span of an identifier, the earliest of equals."""
        lang = F.when(F.endswith("path", F.lit(".py")), "python").otherwise("typescript")
        rows = self.facts.where(F.col("kind") == kind).select("path", "name", F.concat_ws("::", "path", "identifier").alias("identifier"), "line", F.col("span").alias("lines"), lang.alias("language"), F.col("detail").alias("scope"))
        rows = stats.best_per_key(rows, ["identifier"], [F.desc("lines"), F.col("line")])
        return rows.join(self.mentions(), ["language", "name"], "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))

    def signals(self, section: str = "top", limit: int = 20) -> dict[str, Any]:
        """Ranked rows and exact figures of one section, or all; bins count before tests are dropped."""
        if section not in SECTIONS:
            raise ValueError(f"section must be one of {', '.join(SECTIONS)}")
        want = lambda *names: section == "all" or section in names
        top = lambda df, *order: [r.asDict() for r in df.orderBy(*order).limit(limit).collect()]
        out: dict[str, Any] = {}
        functions = self._production(self.definitions("function")) if want("top", "functions", "lengths", "usage", "stats") else None
        if want("top", "functions", "lengths"):
            out["longest_functions"] = top(functions, F.desc("lines"), "mentions", "identifier")
        if want("top", "functions"):
            out["least_mentioned_functions"] = top(functions, "mentions", "lines", "identifier")
        if want("top", "variables"):
            out["longest_variable_names"] = top(self._production(self.definitions("variable")), F.desc(F.length("name")), "mentions", "identifier")
        if want("lengths", "stats"):
            out["lengths"] = [r.asDict() for r in stats.describe(functions, "lines", ["language"]).collect()]
        if want("usage"):
            unique = self.definitions("function").select("language", "name", "mentions").distinct()
            out["usage_bins"] = [r.asDict() for r in stats.bins(unique, "mentions", ["language"]).orderBy("language", "bin").collect()]
        if want("top", "files", "relationships"):
            profiles = self.profiles()
            out["files"] = top(profiles.where("score > 0"), F.desc("score"), "file")
            out["import_hubs"] = [r.asDict() for r in profiles.where("imports_local > 0").orderBy(F.desc("imports_local"), "file").limit(3).select("file", F.col("imports_local").alias("count")).collect()]
            heirs = profiles.withColumn("count", F.col("extends") + F.col("inherits")).where("count > 0")
            out["inheritance_hubs"] = [r.asDict() for r in heirs.orderBy(F.desc("count"), "file").limit(3).select("file", "count").collect()]
        if want("relationships"):
            counts = profiles.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("defines", "imports_local", "exports", "reexports_local", "extends", "inherits", "decorators")))
            relative = self.facts.where("kind IN ('import', 'from') AND (identifier LIKE '.%' OR kind = 'from' AND detail <> '0')").groupBy(F.col("path").alias("file")).agg(F.count("*").alias("relative"))
            counted = profiles.join(relative, "file", "left").withColumn("relative", F.coalesce("relative", F.lit(0))).withColumn("entry", F.col("role") == "likely entrypoint")
            out["relationships"] = counts.first().asDict() | profile_rows.relationship_counts(counted).first().asDict()
        if want("top") or section == "all":
            rows = self._production(fact_rows.metrics(self.files))
            out["complex_functions"] = top(rows, F.desc("cognitive"), F.desc("cyclomatic"), F.desc("span"), "path", "identifier")
        if want("docstrings"):
            out["docstrings"] = self.documentation_totals()
            out["documentation_focus"] = [r.asDict() for r in profile_rows.documentation_focus(self._production(self.docs), self.profiles()).orderBy("path", "kind").collect()]
            out["likely_mains"] = [r.asDict() for r in profile_rows.likely_mains(self._production(self.docs)).collect()]
        return out

    def documentation_totals(self) -> dict[str, Any]:
        counted = fact_rows.documentation_totals(self._production(self.docs)).collect()
        return {r.kind: {"total": r.total, "present": r.present, "coverage": render.percent(r.present / r.total)} for r in sorted(counted)}

    def inspect(self, target: str, limit: int = 10) -> dict[str, Any]:
        """A file, directory or symbol with its neighbourhood."""
        target = target.strip("/")
        inside = self.inventory.where(paths.within(F.col("path"), F.lit(target)))
        if not inside.isEmpty():
            pairs = self.resolved.select("source", "target").distinct()
            crossing = graph.import_boundary(pairs, inside.select(F.col("path").alias("node"))).orderBy("direction", "source", "target").limit(limit).collect()
            held = self.nodes.join(inside.select(F.col("path").alias("file_path")), "file_path", "left_semi")
            entries = inspect_entries.likely_entries(held, self.edges)
            profiles = self.profiles()
            return {
                "target": target,
                "profile": profile_rows.directory_profile(profiles, target).first().asDict(),
                "dense_files": [r.asDict() for r in profile_rows.dense_files(profiles, target, limit).select("file", "total", "samples").collect()],
                "outline": render.outline([r.path for r in inside.select("path").orderBy("path").limit(OUTLINED).collect()]),
                "specifiers": [r.specifier for r in profile_rows.import_specifiers(self.facts, target).orderBy("first", "specifier").limit(limit).collect()],
                "files": [r.asDict() for r in inside.orderBy(F.desc("n_lines"), "path").limit(limit).collect()],
                "definitions": [r.asDict() for r in held.where("line_start IS NOT NULL").select("type", "name", "file_path", "line_start", "line_end").orderBy("file_path", "line_start").limit(limit).collect()],
                "boundary": [r.asDict() for r in crossing],
                "entries": [r.asDict() for r in entries.collect()],
                "documentation": [r.asDict() for r in self.docs.join(inside.select("path"), "path", "left_semi").where("docstring IS NOT NULL").select("path", "kind", "qualified_name", text.preview(F.col("docstring")).alias("preview")).orderBy("path", "qualified_name").limit(limit).collect()],
            }
        low, p = target.lower(), F.lower(F.concat_ws(":", "id", "name", "file_path"))
        exact = (F.lower("id") == low) | (F.lower("name") == low)
        nodes = self.nodes.where(exact | F.contains(p, F.lit(low))).withColumn("tier", F.when(exact, 0).otherwise(1))
        chosen = nodes.orderBy("tier", "file_path", "id").limit(limit).collect()
        best = [r for r in chosen if r.tier == min((c.tier for c in chosen), default=0)]
        out: dict[str, Any] = {"target": target, "candidates": [r.asDict() for r in best]}
        variables = self.facts.where("kind = 'variable'").select(F.col("path").alias("file"), "name", F.concat_ws("::", "path", "name").alias("identifier"), "line", F.col("detail").alias("scope"))
        named = variables.where((F.col("name") == target) | F.endswith("identifier", F.lit("::" + target)))
        if not named.isEmpty():
            out["variables"] = [r.asDict() for r in profile_rows.variable_profile(variables, self.profiles(), target).orderBy("identifier", "line").limit(limit).collect()]
        if len(best) == 1:
            node = best[0]
            calls = self.edges.where("type = 'calls'").select("source", "target")
            out["trace"] = [r.asDict() for r in graph.trace(calls, node.id).orderBy("direction", "hop", "node").limit(limit).collect()]
            near = graph.adjacency(self.edges.select("source", "target", "type")).where(F.col("node") == node.id)
            out["related"] = [r.asDict() for r in near.orderBy("other").limit(limit).collect()]
            if node.line_start:
                wanted = self.spark.createDataFrame([(node.file_path, node.name, node.type if node.type == "class" else "function", node.line_start)], "path string, name string, kind string, line int")
                out["docstring"] = profile_rows.symbol_docstrings(self.docs, wanted).first().docstring
                source = self.files.where(F.col("path") == node.file_path).first()
                out["snippet"] = "\n".join((source.text or "").split("\n")[node.line_start - 1 : node.line_end])
        return out

    def summary(self) -> dict[str, Any]:
        """Structure of the corpus: languages, packages, roots, roles, surfaces, most called, clusters, README."""
        inventory = self._production(self.inventory)
        pairs = self._keep("pairs", lambda: self.resolved.select("source", "target").distinct().withColumn("weight", F.lit(1).cast("long")))
        packages = self._keep("packages", lambda: file_source.packages(self.files))
        roots_rows = packages.select(F.col("root").alias("boundary"))
        if roots_rows.count() <= 1:
            roots_rows = surface_rows.child_boundaries(inventory.where("category = 'code'").select("path"))
        roots = self._keep("roots", lambda: roots_rows, cut=True)
        owned_rows = graph.owning_boundary(inventory.where("category = 'code'"), roots, paths.ancestors(F.col("path"))).select(F.col("path").alias("node"), "boundary").where("boundary IS NOT NULL")
        owned = self._keep("owned", lambda: owned_rows, cut=True)
        between = self._keep("between", lambda: overview.added_weights(graph.boundary_edges(pairs, owned), overview.package_edges(packages, packages.select("root", F.explode("dependencies").alias("dependency")))), cut=True)
        entries = self._keep("entries", lambda: owned.join(inspect_entries.likely_entries(self.nodes, self.edges).select(F.col("file").alias("node")), "node").select(F.col("boundary").alias("node")), cut=True)
        calls = self.edges.where("type = 'calls'")
        readme = self.files.where(F.lower("path").isin("readme.md", "readme.rst", "readme.txt", "readme")).first()
        labels = self._keep("labels", lambda: graph.clusters(pairs, keep=self._materialised))
        sizes = self._keep("sizes", lambda: graph.cluster_summary(pairs, labels))
        owners = labels.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_set("node")), 1, 100).alias("files"))
        named = sizes.join(owners, "cluster").select("cluster", "members", F.lit(None).cast("string").alias("label"), F.transform("files", lambda f: paths.basename(f)).alias("names"), "files")
        clusters = sizes.join(overview.cluster_labels(named), "cluster")
        shown = self.facts.where("kind = 'export'").join(inventory.select("path"), "path", "left_semi").groupBy(F.col("path").alias("file")).agg(F.count_distinct("name").alias("names"))
        reached = self.resolved.groupBy(F.col("source").alias("file")).agg(F.count_distinct("target").alias("origins"))
        importers = graph.fan_in(pairs).select(F.col("node").alias("file"), F.col("importers").alias("fan_in"))
        candidates = shown.join(reached, "file", "left").join(importers, "file", "left").join(entries_of(packages), "file", "left").na.fill(0, ["origins", "fan_in"]).withColumn("declared", F.coalesce("declared", F.lit(False)))
        focus = roots.select("boundary").distinct().withColumn("ord", F.dense_rank().over(Window.orderBy("boundary"))).select("ord", F.col("boundary").alias("focus"))
        surfaces = overview.surface_winners(candidates.persist(), focus).join(shown, "file")
        return {
            "languages": [r.asDict() for r in stats.shares(inventory, "language", F.col("n_bytes")).orderBy(F.desc("weight"), "language").collect()],
            "packages": [r.asDict() for r in packages.orderBy("root").collect()],
            "roles": [r.asDict() for r in graph.roles(between, entries).orderBy("role").collect()],
            "boundaries": [r.asDict() for r in between.orderBy(F.desc("weight"), "source", "target").limit(20).collect()],
            "surfaces": [r.asDict() for r in surfaces.orderBy("ord", "kind", "file").limit(8).collect()],
            "most_called": [self._described(r) for r in overview.most_called(calls.select(F.substring_index("target", ":", -1).alias("target"))).orderBy(F.desc("calls"), "target").limit(10).collect()],
            "clusters": [r.asDict() for r in clusters.orderBy(F.desc("members"), "cluster").limit(8).collect()],
            "references": [r.asDict() for r in overview.compacted_references(between.select(F.col("source").alias("node"), F.col("target").alias("other")), "target").orderBy("node", "label").limit(20).collect()],
            "unscanned": [r.language for r in definitions.unscanned_languages(inventory.where("category = 'code'")).orderBy("language").collect()],
            "unparsed": [r.asDict() for r in definitions.unparsed_definitions(self.files).groupBy(paths.suffix(F.col("file_path")).alias("suffix")).agg(F.count("*").alias("definitions")).orderBy("suffix").collect()],
            "readme": [{"level": a, "heading": b, "content": c} for a, b, c in file_source.readme_outline(readme.text)] if readme else [],
        }

    def _described(self, row) -> dict[str, Any]:
        """A most called symbol with the file and description of the one definition that it means."""
        found = profile_rows.symbols_by_name(self.facts).where(F.col("name") == row.target).select("path", "name", "line").distinct().limit(2).collect()
        if len(found) != 1:
            return row.asDict()
        own = self.docs.where(F.col("path") == found[0].path)
        about = profile_rows.descriptions(own, self.spark.createDataFrame(found)).first()
        return row.asDict() | {"file": about.path, "description": about.description}

    def schema(self) -> dict[str, Any]:
        """Nodes of each label, edges of each type."""
        out: dict[str, Any] = {"labels": {}, "types": {}}
        for r in graph.schema_counts(self.nodes, self.edges).collect():
            out[r.part][r.name] = r.n
        return out

    def query(self, sql: str, max_rows: int = 200) -> list[dict]:
        """Read-only SQL over the views nodes, edges, files, facts, docs."""
        if not text.read_only(sql):
            raise ValueError("only queries that read are allowed")
        for name, df in (("nodes", self.nodes), ("edges", self.edges), ("files", self.inventory), ("facts", self.facts), ("docs", self.docs)):
            df.createOrReplaceTempView(name)
        return [r.asDict() for r in self.spark.sql(sql).limit(max_rows).collect()]

    def changes(self, other: DataFrame, hops: int = 2) -> list[dict]:
        """Files that differ from another state of the corpus, and what depends on them."""
        return self.changes_since(other.select(F.col("path").alias("node"), F.xxhash64("text").alias("digest")), hops)

    def changes_since(self, digests: DataFrame, hops: int = 2) -> list[dict]:
        """As ``changes``, against a saved state (node, digest)."""
        own = self.files.select(F.col("path").alias("node"), F.xxhash64("text").alias("digest"))
        rows = graph.change_impact(digests, own, self.resolved.select("source", "target").distinct(), hops)
        return [r.asDict() for r in rows.orderBy("hop", "node").collect()]


def entries_of(packages: DataFrame) -> DataFrame:
    """(file, declared): the files that packages name as entries."""
    path = F.regexp_replace(F.concat_ws("/", F.nullif("root", F.lit("")), F.regexp_replace("entry", r"^\./", "")), "/+", "/")
    return packages.select("root", F.explode("entries").alias("entry")).select(path.alias("file"), F.lit(True).alias("declared")).distinct()


#: Files of a directory that its outline lists.
OUTLINED = 1000
_SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
