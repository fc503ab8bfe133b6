"""Facts of one Python file, from the standard library's parser.

A fact is (kind, name, identifier, line, span, owner, detail). Where a file does not
parse, patterns over its lines give definitions and imports, and ``parse_error`` is one
more fact; documentation reports of such a file hold the error alone.
"""

from __future__ import annotations

import ast
import re
import textwrap

Fact = tuple[str, str, str, int, int, str, str]


class _Walker(ast.NodeVisitor):
    def __init__(self, source: str):
        self.source, self.facts, self.scope = source, [], []  # scope: (name, kind)

    def add(self, kind: str, name: str, node: ast.AST, detail: str = "", identifier: str = "", owner: str | None = None) -> None:
        functions = [n for n, k in self.scope if k == "function"]
        start, end = getattr(node, "lineno", 0), getattr(node, "end_lineno", None) or getattr(node, "lineno", 0)
        self.facts.append((kind, name, identifier or ".".join([*(n for n, _ in self.scope), name]), start, end - start + 1, (functions[-1] if functions else "") if owner is None else owner, detail))

    def _function(self, node) -> None:
        outer = self.scope
        self.add("function", node.name, node, "nested" if outer else "top")
        for decorator in node.decorator_list:
            self.add("decorator", ast.unparse(decorator), decorator)
            self.visit(decorator)
        for part in [*node.args.defaults, *(d for d in node.args.kw_defaults if d), *(a.annotation for a in ast.walk(node.args) if isinstance(a, ast.arg) and a.annotation), *([node.returns] if node.returns else [])]:
            self.visit(part)  # defaults and annotations belong to the outer function
        self.scope = [*outer, (node.name, "function")]
        for statement in node.body:
            self.visit(statement)
        self.scope = outer

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node.name, node)
        for base in node.bases:
            self.add("base", ast.unparse(base), base, node.name)
            self.visit(base)
        for decorator in node.decorator_list:
            self.add("decorator", ast.unparse(decorator), decorator)
            self.visit(decorator)
        for keyword in node.keywords:
            self.visit(keyword.value)
        self.scope.append((node.name, "class"))
        for statement in node.body:
            self.visit(statement)
        self.scope.pop()

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self.add("import", alias.name, node, "0", alias.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for alias in node.names:
            self.add("from", alias.name, node, str(node.level), node.module or "")

    def _targets(self, target: ast.AST, depth: int = 0) -> None:
        if isinstance(target, ast.Name):
            self.add("variable", target.id, target, "local" if self.scope else "module")
        elif isinstance(target, ast.Starred):
            self._targets(target.value, depth + 1)
        elif isinstance(target, (ast.Tuple, ast.List)) and depth < 4:
            for item in target.elts:
                self._targets(item, depth + 1)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            self._targets(target)
            if isinstance(target, ast.Name) and target.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple, ast.Set)):
                for item in node.value.elts:
                    if isinstance(item, ast.Constant) and isinstance(item.value, str):
                        self.add("export", item.value, item)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._targets(node.target)
        self.generic_visit(node)

    visit_AugAssign = visit_AnnAssign

    def visit_Call(self, node: ast.Call) -> None:
        functions = [n for n, k in self.scope if k == "function"]
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
        if name:
            self.add("call" if functions else "top_call", name, node, ast.unparse(node.func), name)
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        if not self.scope and ast.unparse(node.test) in ("__name__ == '__main__'", "'__main__' == __name__"):
            self.add("main_guard", "__main__", node)
        self.generic_visit(node)


_LINES = (
    ("function", re.compile(r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\(", re.M)),
    ("class", re.compile(r"^(\s*)class\s+(\w+)", re.M)),
    ("import", re.compile(r"^(\s*)import\s+([\w.]+)", re.M)),
)


def scan(source: str) -> list[Fact]:
    """All facts of a file."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as error:
        out: list[Fact] = [("parse_error", "invalid syntax", "", getattr(error, "lineno", 0) or 0, 0, "", "")]
        for kind, pattern in _LINES:
            for m in pattern.finditer(source):
                line = source.count("\n", 0, m.start(2)) + 1
                out.append((kind, m[2], m[2], line, 1, "", "0" if kind == "import" else "top" if not m[1].strip("\n") else "nested"))
        for m in re.finditer(r"^\s*from\s+(\.*)([\w.]*)\s+import\s+\(?([\w, \t]+)", source, re.M):
            line = source.count("\n", 0, m.start(1)) + 1
            out += [("from", n.split()[0], m[2], line, 1, "", str(len(m[1]))) for n in m[3].split(",") if n.strip()]
        return out
    walker = _Walker(source)
    walker.visit(tree)
    return walker.facts


def complexity(node: ast.AST) -> tuple[int, int, int]:
    """(cyclomatic, cognitive, linear scans inside loops) of a function.

    Cyclomatic: 1 and each branch. Cognitive: each branch and its nesting. The last counts
    membership tests, ``count``, ``index`` and whole-list builtins inside loops.
    """
    branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
    figures = [1, 0, 0]

    def walk(n: ast.AST, nesting: int, loops: int) -> None:
        for child in ast.iter_child_nodes(n):
            deeper, looped = nesting, loops
            if isinstance(child, branches):
                figures[0] += 1
                figures[1] += 1 + nesting
                deeper += 1
            if isinstance(child, (ast.For, ast.AsyncFor, ast.While, ast.comprehension)):
                looped += 1
            if isinstance(child, ast.BoolOp):
                figures[0] += len(child.values) - 1
                figures[1] += 1
            if loops and isinstance(child, ast.Compare) and any(isinstance(o, (ast.In, ast.NotIn)) for o in child.ops):
                figures[2] += 1
            if loops and isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else getattr(child.func, "attr", "")
                figures[2] += name in ("count", "index", "sorted", "sum", "min", "max", "remove")
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                deeper += 1
            walk(child, deeper, looped)

    walk(node, 0, 0)
    return tuple(figures)


def metrics(source: str) -> list[tuple[str, int, int, int, int, int]]:
    """(identifier, line, span, cyclomatic, cognitive, hidden_quadratic) of each function."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def walk(node: ast.AST, names: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            inner = names
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = (*names, child.name)
                if not isinstance(child, ast.ClassDef):
                    out.append((".".join(inner), child.lineno, (child.end_lineno or child.lineno) - child.lineno + 1, *complexity(child)))
            walk(child, inner)

    walk(tree, ())
    return out


def _doc(body: list[ast.stmt], source: str) -> str | None:
    """A docstring's source text without quotes, dedented; None of bytes, f-strings and others."""
    if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, ast.Constant) or not isinstance(body[0].value.value, str):
        return None
    text = ast.get_source_segment(source, body[0].value) or ""
    pieces = [m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] if m[4] is not None else m[5] for m in re.finditer(r"""([rRuU]?)(?:\"\"\"([\s\S]*?)\"\"\"|'''([\s\S]*?)'''|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')""", text)]
    return textwrap.dedent("".join(pieces)).strip()


def documentation(source: str) -> list[tuple[str, str, str, str, int, str | None, str | None, str | None, str | None]]:
    """(kind, name, qualified name, parent, line, inputs, outputs, docstring, parse error) of a file and its definitions."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [("file", "", "", "", 1, None, None, None, "invalid syntax")]
    out = [("file", "", "", "", 1, None, None, _doc(tree.body, source), None)]

    def walk(body: list[ast.stmt], parents: tuple[str, ...], in_class: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = ".".join([*parents, node.name])
                out.append(("method" if in_class else "function", node.name, name, ".".join(parents), node.lineno, ast.unparse(node.args), ast.unparse(node.returns) if node.returns else None, _doc(node.body, source), None))
                walk(node.body, (*parents, node.name), False)
            elif isinstance(node, ast.ClassDef):
                out.append(("class", node.name, ".".join([*parents, node.name]), ".".join(parents), node.lineno, None, None, _doc(node.body, source), None))
                walk(node.body, (*parents, node.name), True)
            else:
                for inner in ("body", "orelse", "finalbody"):
                    walk([s for s in getattr(node, inner, []) if isinstance(s, ast.stmt)], parents, in_class)

    walk(tree.body, (), False)
    return out
