"""Queries over source trees: facts, imports, graph, documentation, structural rules.

The sources are written by Spark from ``nation`` and ``supplier``: a Python package for each
nation, a module (every tenth one broken) and three scripts for each supplier. So trees grow
with the tables, and SQL can say from the keys what scanners have to find.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import paths
from corpuscle.operators import facts, graph, imports, inspect_entries, match, search, surfaces, trees
from corpuscle.operators.kept import kept
from corpuscle.plans.registry import query
from corpuscle.sources.tables import table

#: Sources of a nation (J, N for key and name) and of a supplier (K, and J for its nation), by path.
NATION = {
    "nJ/__init__.py": '"""Nation N."""\nfrom .base import Base\n__all__ = ["Base"]\n',
    "nJ/base.py": "from . import util\n\n\nclass Base:\n    pass\n",
    "nJ/util.py": "LEFT, (RIGHT, _) = 1, (2, 3)\n\n\ndef helper(x):\n    for i in range(x):\n        if i in [1, 2]:\n            x += i\n    return x\n\n\ndef other():\n    return helper(3)\n",
    "nJ/main.py": "import nJ.util\nfrom nJ import base\nfrom nJ.base import Base\n\nif __name__ == '__main__':\n    Base().run(J)\n",
    "nJ/README.md": "# N\n\nProse.\n\n## Install\n\nnpm\n",
}
MODULE = 'from . import util\nfrom .util import helper as run_helper\nfrom .base import Base\n\n\nclass SK(Base):\n    """Runs K."""\n\n    def run(self, value: int = 1) -> int:\n        """Run once."""\n        def inner(x):\n            return run_helper(x)\n        return inner(value)\n\n    def stop(self):\n        return self.run(K)\n'
BROKEN = "def lost(:\n    pass\nimport nJ.util\n"
SCRIPTS = {
    "web/sK/index.ts": "export * from './shape';\nexport { area as size } from './area.js';\nexport const version = 'K';\n",
    "web/sK/shape.ts": "import { area } from './area';\n/** Square K. */\nexport class SquareK extends Shape {\n  side() {\n    return area(2, K);\n  }\n}\nexport interface Options { on: boolean }\n",
    "web/sK/area.ts": "// Multiplies.\nexport const area = (a: number, b: number) => multiply(a, b);\nfunction multiply(a: number, b: number) {\n  return a * b;\n}\n",
}
#: Keys of the rows in SQL: nations (j, n), suppliers (j, k) of modules that parse, and all suppliers.
_KEYS = "n AS (SELECT n_nationkey AS j, n_name AS n FROM nation), s AS (SELECT s_nationkey AS j, s_suppkey AS k FROM supplier), good AS (SELECT * FROM s WHERE k % 10 <> 0), broken AS (SELECT * FROM s WHERE k % 10 = 0)"
_MODULE = "'n' || j || '/s' || k || '.py'"


def _filled(template: str, **values) -> F.Column:
    out = F.lit(template)
    for letter, column in values.items():
        out = F.regexp_replace(out, F.lit(rf"(?<![A-Za-z]){letter}(?![A-Za-z])|(?<=(?<![A-Za-z])(?:n|s|S)){letter}|(?<=Square){letter}"), column.cast("string"))
    return out


def tree(spark, sf_dir) -> DataFrame:
    """(path, text) of all sources."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("n"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("j"), F.col("s_suppkey").alias("k"))
    of_nation = F.array(*(F.struct(_filled(p, J=F.col("j")).alias("path"), _filled(t, J=F.col("j"), N=F.col("n")).alias("text")) for p, t in NATION.items()))
    keys = {"J": F.col("j"), "K": F.col("k")}
    module = F.struct(_filled("nJ/sK.py", **keys).alias("path"), F.when(F.col("k") % 10 == 0, _filled(BROKEN, **keys)).otherwise(_filled(MODULE, **keys)).alias("text"))
    of_supplier = F.array(module, *(F.struct(_filled(p, **keys).alias("path"), _filled(t, **keys).alias("text")) for p, t in SCRIPTS.items()))
    return nations.select(F.inline(of_nation)).unionByName(suppliers.select(F.inline(of_supplier)))


#: What is written once for a session and folder: sources, facts, imports, nodes, edges.
_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of the tree, computed when first asked for and kept in the checkpoint folder."""
    have = _WRITTEN.setdefault(spark, {})
    if (sf_dir, name) not in have:
        get = lambda other: written(spark, sf_dir, other)
        if name == "files":
            have[sf_dir, name] = kept(tree(spark, sf_dir))
        elif name == "facts":
            have[sf_dir, name] = kept(facts.facts(get("files")))
        elif name == "documentation":
            have[sf_dir, name] = kept(facts.documentation(get("files")))
        elif name == "scripts":
            have[sf_dir, name] = kept(imports.script_imports(get("facts"), get("files").select("path")))
        elif name == "imports":
            python = imports.python_imports(get("facts"), get("files").select("path")).select("source", "target")
            have[sf_dir, name] = kept(python.unionByName(get("scripts").select("source", "target")).distinct())
        else:
            lines = get("files").select("path", search.line_count(F.col("text")).alias("n_lines"))
            nodes, edges = imports.nodes_and_edges(lines, get("facts"), get("imports"))
            have[sf_dir, "nodes"], have[sf_dir, "edges"] = kept(nodes), kept(edges)
    return have[sf_dir, name]


@query(
    "syntax_functions",
    f"""WITH {_KEYS} SELECT 'n' || j || '/util.py' AS path, t.* FROM n, (VALUES ('helper', 4, 5), ('other', 11, 2)) t(identifier, line, span)
    UNION ALL SELECT {_MODULE}, 'S' || k || t.i, line, span FROM good, (VALUES ('.run', 9, 5), ('.run.inner', 11, 2), ('.stop', 15, 2)) t(i, line, span)
    UNION ALL SELECT {_MODULE}, 'lost', 1, 1 FROM broken UNION ALL SELECT 'web/s' || k || t.f, i, line, span FROM s, (VALUES ('/shape.ts', 'side', 4, 3), ('/area.ts', 'area', 2, 1), ('/area.ts', 'multiply', 3, 3)) t(f, i, line, span)""",
)
def syntax_functions(spark, sf_dir):
    """Functions and methods with their spans; a broken file still gives its own."""
    return written(spark, sf_dir, "facts").where("kind = 'function'").select("path", "identifier", "line", "span")


@query(
    "syntax_calls",
    f"""WITH {_KEYS} SELECT 'n' || j || '/util.py' AS path, t.* FROM n, (VALUES ('helper', 'range', 5), ('other', 'helper', 12)) t(caller, callee, line)
    UNION ALL SELECT {_MODULE}, t.* FROM good, (VALUES ('inner', 'run_helper', 12), ('run', 'inner', 13), ('stop', 'run', 16)) t(a, b, l)
    UNION ALL SELECT 'web/s' || k || t.f, a, b, l FROM s, (VALUES ('/shape.ts', 'side', 'area', 5), ('/area.ts', 'area', 'multiply', 2)) t(f, a, b, l)""",
)
def syntax_calls(spark, sf_dir):
    """Calls with the function that owns them."""
    return written(spark, sf_dir, "facts").where("kind = 'call'").select("path", F.col("owner").alias("caller"), F.col("name").alias("callee"), "line")


_IMPORTS = f"""SELECT 'n' || j || t.a AS source, 'n' || j || t.b AS target FROM n, (VALUES ('/__init__.py', '/base.py'), ('/base.py', '/util.py'), ('/main.py', '/util.py'), ('/main.py', '/base.py')) t(a, b)
    UNION ALL SELECT {_MODULE}, 'n' || j || t.b FROM good, (VALUES ('/util.py'), ('/base.py')) t(b) UNION ALL SELECT {_MODULE}, 'n' || j || '/util.py' FROM broken
    UNION ALL SELECT 'web/s' || k || t.a, 'web/s' || k || t.b FROM s, (VALUES ('/index.ts', '/shape.ts'), ('/index.ts', '/area.ts'), ('/shape.ts', '/area.ts')) t(a, b)"""


@query("import_map", f"WITH {_KEYS} {_IMPORTS}")
def import_map(spark, sf_dir):
    """Imports resolved to files of the tree."""
    return written(spark, sf_dir, "imports")


@query(
    "export_closure",
    f"WITH {_KEYS}, k AS (SELECT min(k) AS k FROM s) SELECT 'version' AS name, 'web/s' || k || '/index.ts' AS origin FROM k UNION ALL SELECT 'size', 'web/s' || k || '/area.ts' FROM k UNION ALL SELECT 'Square' || k, 'web/s' || k || '/shape.ts' FROM k UNION ALL SELECT 'Options', 'web/s' || k || '/shape.ts' FROM k",
)
def export_closure(spark, sf_dir):
    """Public names of the first supplier's index, followed to where they are defined."""
    first = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    return imports.export_closure(written(spark, sf_dir, "facts"), written(spark, sf_dir, "files"), written(spark, sf_dir, "scripts"), f"web/s{first}/index.ts", cut=kept)


@query(
    "graph_edge_types",
    f"""WITH {_KEYS}, i AS ({_IMPORTS}) SELECT 'imports' AS type, count(*) AS n FROM i
    UNION ALL SELECT 'contains', ((SELECT 3 * count(*) FROM n) + (SELECT 4 * count(*) FROM good) + (SELECT count(*) FROM broken) + (SELECT 4 * count(*) FROM s))::BIGINT
    UNION ALL SELECT 'calls', ((SELECT count(*) FROM n) + (SELECT 2 * count(*) FROM good) + (SELECT count(*) FROM s))::BIGINT""",
)
def graph_edge_types(spark, sf_dir):
    """Edges of the tree's graph by type."""
    return written(spark, sf_dir, "edges").groupBy("type").agg(F.count("*").alias("n"))


@query(
    "documentation",
    f"""WITH {_KEYS} SELECT 'n' || j || '/__init__.py' AS path, 'file' AS kind, '' AS qualified_name, 'Nation ' || n || '.' AS docstring FROM n
    UNION ALL SELECT {_MODULE}, 'class', 'S' || k, 'Runs ' || k || '.' FROM good UNION ALL SELECT {_MODULE}, 'method', 'S' || k || '.run', 'Run once.' FROM good
    UNION ALL SELECT 'web/s' || k || '/shape.ts', 'class', 'Square' || k, 'Square ' || k || '.' FROM s UNION ALL SELECT 'web/s' || k || '/area.ts', 'function', 'area', 'Multiplies.' FROM s""",
)
def documentation(spark, sf_dir):
    """Documented files, classes and functions."""
    return written(spark, sf_dir, "documentation").where("docstring IS NOT NULL").select("path", "kind", "qualified_name", "docstring")


@query(
    "signatures",
    f"""WITH {_KEYS} SELECT 'n' || j || '/util.py' AS path, t.* FROM n, (VALUES ('helper', 'x', NULL), ('other', '', NULL)) t(qualified_name, inputs, outputs)
    UNION ALL SELECT {_MODULE}, 'S' || k || i, inputs, outputs FROM good, (VALUES ('.run', 'self, value: int=1', 'int'), ('.run.inner', 'x', NULL), ('.stop', 'self', NULL)) t(i, inputs, outputs)""",
)
def signatures(spark, sf_dir):
    """Parameters and results of Python functions and methods."""
    rows = written(spark, sf_dir, "documentation").where("kind IN ('function', 'method') AND path LIKE '%.py'")
    return rows.select("path", "qualified_name", "inputs", "outputs")


_PROFILE = "file, lines, defines, imports_local, exports, extends, inherits, score, role"


@query(
    "file_profiles",
    f"""WITH {_KEYS}, t AS (SELECT 'n' || j || f AS file, l AS lines, d AS defines, i AS imports_local, e AS exports, 0 AS extends, 0 AS inherits FROM n, (VALUES ('/__init__.py', 3, 0, 1, 1), ('/base.py', 5, 1, 1, 0), ('/util.py', 12, 2, 0, 0), ('/main.py', 6, 0, 2, 0), ('/README.md', 7, 0, 0, 0)) v(f, l, d, i, e)
      UNION ALL SELECT {_MODULE}, 16, 1, 2, 0, 0, 1 FROM good UNION ALL SELECT {_MODULE}, 3, 1, 1, 0, 0, 0 FROM broken
      UNION ALL SELECT 'web/s' || k || f, l, d, i, e, x, 0 FROM s, (VALUES ('/index.ts', 3, 0, 2, 2, 0), ('/shape.ts', 8, 2, 1, 2, 1), ('/area.ts', 5, 2, 0, 1, 0)) v(f, l, d, i, e, x))
    SELECT file, lines, defines, imports_local, exports, extends, inherits, defines * 5 + imports_local * 6 + (extends + inherits) * 3 + exports AS score,
      CASE WHEN file LIKE '%/main.py' OR file LIKE '%/index.ts' THEN 'likely entrypoint' ELSE 'likely module' END AS role FROM t""",
)
def file_profiles(spark, sf_dir):
    """What each file defines, imports and exports, its structural score and likely role."""
    lines = written(spark, sf_dir, "files").select("path", search.line_count(F.col("text")).alias("n_lines"))
    rows = facts.profiles(written(spark, sf_dir, "facts"), written(spark, sf_dir, "imports").withColumn("type", F.lit("imports")), lines)
    entry = F.array_contains(paths.tags(F.col("file"), F.lit("code"), F.lit("x")), "entry-candidate")
    judged = rows.withColumn("reexports_local", F.lit(0)).withColumn("entry", entry).withColumn("role", facts.role()).withColumn("score", facts.score())
    return judged.select(*_PROFILE.split(", "))


@query("parse_errors", f"WITH {_KEYS} SELECT {_MODULE} AS path, 'invalid syntax' AS parse_error FROM broken")
def parse_errors(spark, sf_dir):
    """Files that don't parse."""
    return written(spark, sf_dir, "documentation").where("parse_error IS NOT NULL").select("path", "parse_error")


@query(
    "complexity",
    f"""WITH {_KEYS} SELECT 'n' || j || '/util.py' AS path, t.* FROM n, (VALUES ('helper', 3, 3, 1), ('other', 1, 0, 0)) t(identifier, cyclomatic, cognitive, hidden_quadratic)
    UNION ALL SELECT {_MODULE}, 'S' || k || i, 1, 0, 0 FROM good, (VALUES ('.run'), ('.run.inner'), ('.stop')) t(i)""",
)
def complexity(spark, sf_dir):
    """Branches, nesting and scans inside loops of Python functions."""
    return facts.metrics(written(spark, sf_dir, "files")).select("path", "identifier", "cyclomatic", "cognitive", "hidden_quadratic")


@query("member_of", f"WITH {_KEYS} SELECT {_MODULE} AS path, t.* FROM (SELECT * FROM good ORDER BY k LIMIT 1), (VALUES ('run', 9), ('inner', 11), ('stop', 15)) AS t(name, line)")
def member_of(spark, sf_dir):
    """Functions inside the span of the first supplier's class."""
    first = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").agg(F.min("s_suppkey")).first()[0]
    return facts.members(written(spark, sf_dir, "facts"), f"S{first}")


@query(
    "variables",
    f"WITH {_KEYS} SELECT 'n' || j || '/util.py' AS path, t.* FROM n, (VALUES ('LEFT', 'module'), ('RIGHT', 'module'), ('_', 'module'), ('x', 'local')) t(name, scope) UNION ALL SELECT 'web/s' || k || '/index.ts', 'version', 'module' FROM s",
)
def variables(spark, sf_dir):
    """Assigned names, destructuring opened in Python; __all__ is left out."""
    return written(spark, sf_dir, "facts").where("kind = 'variable' AND name <> '__all__'").select("path", "name", F.col("detail").alias("scope")).distinct()


@query(
    "likely_entries",
    f"""WITH {_KEYS}, a AS (SELECT 'web/s' || k || '/index.ts' AS file, 129 AS score, 'package surface' AS role FROM s ORDER BY file LIMIT 2),
    m AS (SELECT 'n' || j || '/main.py' AS file, 110 AS score, 'implementation surface' AS role FROM n ORDER BY file LIMIT 6) SELECT * FROM a UNION ALL SELECT * FROM m""",
)
def likely_entries(spark, sf_dir):
    """Where to begin reading the tree."""
    return inspect_entries.likely_entries(written(spark, sf_dir, "nodes"), written(spark, sf_dir, "edges"))


@query(
    "node_tags",
    f"""WITH {_KEYS} SELECT 'n' || j || t.f AS file_path, type, tags FROM n, (VALUES ('/README.md', 'document', 'docs,entry-documentation,markdown'), ('/main.py', 'file', 'code,entry-candidate,python')) t(f, type, tags)
    UNION ALL SELECT 'web/s' || k || '/index.ts', 'file', 'code,entry-candidate,typescript' FROM s""",
)
def node_tags(spark, sf_dir):
    """Type and tags of entry files."""
    nodes = written(spark, sf_dir, "nodes").where("file_path RLIKE '(README.md|main.py|index.ts)$' AND line_start IS NULL")
    return nodes.select("file_path", "type", F.array_join("tags", ",").alias("tags"))


@query("graph_search", f"WITH {_KEYS} SELECT t.a || 'web/s' || k || '/area.ts' || t.b AS id, 108 AS score FROM s, (VALUES ('function:', ':multiply'), ('function:', ':area'), ('file:', '')) t(a, b)")
def graph_search(spark, sf_dir):
    """Nodes that hold a phrase themselves or by an edge."""
    return graph.search_nodes(written(spark, sf_dir, "nodes"), written(spark, sf_dir, "edges"), "multiply").select("id", "score")


@query(
    "pattern_match",
    f"WITH {_KEYS} SELECT {_MODULE} AS path, 16 AS line, 'self.run(' || k || ')' AS text FROM good",
)
def pattern_match(spark, sf_dir):
    """Places of a call pattern with a metavariable."""
    return match.matches(written(spark, sf_dir, "files"), "self.run($A)", "python").select("path", "line", "text")


@query(
    "enclosing_definitions",
    f"WITH {_KEYS} SELECT 'n' || j || '/util.py' AS path, name, 1::BIGINT AS matches FROM n, (VALUES ('other'), ('helper')) t(name) UNION ALL SELECT {_MODULE}, 'inner', 1 FROM good",
)
def enclosing_definitions(spark, sf_dir):
    """Text hits counted by the definition that holds them."""
    hits = search.literal_matches(written(spark, sf_dir, "files"), "helper(", per_file=10)
    return surfaces.enclosing_definitions(hits, written(spark, sf_dir, "facts"))


@query("related_sections", f"WITH {_KEYS}, k AS (SELECT min(k) AS k FROM s) SELECT 'in' AS label, 'file:web/s' || k || '/area.ts' AS other FROM k UNION ALL SELECT 'calls', 'function:web/s' || k || '/area.ts:multiply' FROM k")
def related_sections(spark, sf_dir):
    """A node's edges, worded from its side."""
    first = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    return surfaces.related_sections(written(spark, sf_dir, "edges"), written(spark, sf_dir, "nodes"), f"function:web/s{first}/area.ts:area").select("label", "other")


@query(
    "role_names",
    f"WITH {_KEYS} SELECT 'runner' || k AS label, 'Runner' || k || 's' AS name FROM s WHERE k % 3 = 0 UNION ALL SELECT 'shapes' || k, unnest(['shapeOf' || k, 'makeShape' || k]) FROM s WHERE k % 3 = 1",
)
def role_names(spark, sf_dir):
    """Names that match a label: the same but for a plural, else the closest."""
    forms = F.expr(
        """CASE k % 3 WHEN 0 THEN array(struct('runner' || k, 'Runner' || k || 's'), struct('runner' || k, 'Runner' || k || 'Factory'))
        WHEN 1 THEN array(struct('shapes' || k, 'shapeOf' || k), struct('shapes' || k, 'makeShape' || k), struct('shapes' || k, 'makeShapeNow' || k), struct('shapes' || k, '_shape' || k))
        ELSE array(struct('none' || k, 'other' || k)) END"""
    )
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return surfaces.role_names(keys.select(F.inline(forms)).toDF("label", "name"))


@query("unique_symbols", f"WITH {_KEYS} SELECT 'a' || k AS name, 'x' AS qualified, 'm/a.py' AS path FROM s UNION ALL SELECT 'b' || k, 'm.c.b' || k, 'm/c.py' FROM s")
def unique_symbols(spark, sf_dir):
    """Names that mean one symbol."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    named = lambda rows: F.array(*(F.struct(F.concat(F.lit(n), F.col("k").cast("string")).alias("name"), F.concat(F.lit(v), F.col("k").cast("string")).alias("v") if n == "b" and "." in v and "/" not in v else F.lit(v).alias("v")) for n, v in rows))
    symbols = keys.select(F.inline(named([("a", "m/a.py"), ("b", "m/b.py"), ("b", "m/c.py"), ("c", "p.py"), ("c", "q.py")]))).toDF("name", "path")
    wanted = keys.select(F.inline(named([("a", "x"), ("b", "m.c.b"), ("c", "z"), ("d", "d")]))).toDF("name", "qualified")
    return surfaces.unique_symbols(symbols, wanted)


@query("rule_inside", f"WITH {_KEYS} SELECT {_MODULE} AS path, 12 AS line, 20 AS col, 'run_helper(x)' AS text FROM good UNION ALL SELECT {_MODULE}, 13, 16, 'inner(value)' FROM good UNION ALL SELECT {_MODULE}, 16, 16, 'self.run(' || k || ')' FROM good")
def rule_inside(spark, sf_dir):
    """Calls anywhere inside a class."""
    rule = {"kind": "call", "inside": {"kind": "class_definition", "stopBy": "end"}}
    return trees.rule_matches(written(spark, sf_dir, "files"), rule, "python").select("path", "line", "col", "text")


@query("rule_has", f"WITH {_KEYS} SELECT 'n' || j || '/util.py' AS path, 4 AS line, 8 AS end_line FROM n UNION ALL SELECT {_MODULE}, 9, 13 FROM good")
def rule_has(spark, sf_dir):
    """Functions that hold a loop at any depth, or a function as their own statement."""
    rule = {"kind": "function_definition", "any": [{"has": {"kind": "for_statement", "stopBy": "end"}}, {"has": {"kind": "function_definition"}}]}
    return trees.rule_matches(written(spark, sf_dir, "files"), rule, "python").select("path", "line", "end_line")


@query("rule_all", f"WITH {_KEYS} SELECT {_MODULE} AS path, 15 AS line FROM good WHERE k % 2 = 1")
def rule_all(spark, sf_dir):
    """Functions of a class's body that come after another one and hold a call whose number is odd."""
    call = {"pattern": "self.run($N)", "stopBy": "end"}
    rule = {"all": [{"kind": "function_definition"}, {"inside": {"kind": "class_definition"}}, {"follows": {"kind": "function_definition"}}, {"has": call}]}
    return trees.rule_matches(written(spark, sf_dir, "files"), rule, "python", constraints={"N": {"regex": "[13579]$"}}).select("path", "line")


@query("rule_not", f"WITH {_KEYS} SELECT 'n' || j || '/util.py' AS path, 11 AS line FROM n UNION ALL SELECT {_MODULE}, 11 FROM good")
def rule_not(spark, sf_dir):
    """Functions without a loop that don't stand in a class's body."""
    rule = {"kind": "function_definition", "all": [{"not": {"has": {"kind": "for_statement", "stopBy": "end"}}}, {"not": {"inside": {"kind": "class_definition"}}}]}
    return trees.rule_matches(written(spark, sf_dir, "files"), rule, "python").select("path", "line")


@query("rules_of_pages")
def rules_of_pages(spark, sf_dir):
    """Several rules over the elements of all pages, read once: paragraphs, lists and links by where they stand."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return trees.rules_matches(files, PAGE_RULES, "html", texts=False).groupBy("rule", "path").agg(F.count("*").alias("n"))


PAGE_RULES = [
    ("article paragraphs", {"kind": "p", "inside": {"kind": "article", "stopBy": "end"}, "not": {"has": {"kind": "b", "stopBy": "end"}}}),
    ("menu links", {"kind": "a", "inside": {"kind": "li", "inside": {"kind": "nav", "stopBy": "end"}}}),
    ("after a heading", {"kind": "p", "follows": {"any": [{"kind": "h1"}, {"kind": "h2"}]}}),
    ("divs of text", {"kind": "div", "has": {"kind": "p"}, "not": {"precedes": {"kind": "footer", "stopBy": "end"}}}),
]
