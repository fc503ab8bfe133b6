"""Syntax trees as rows of nested sets, and structural rules as joins and windows over them.

``syntax_nodes`` reads each file once and gives a row for each node: ``pre`` numbers nodes in
the order of their beginnings, ``last`` is the largest number within a node, ``parent`` the
number of the node around it, ``nth`` its place among siblings; ``atoms`` lists the plain
conditions (kinds, patterns, regular expressions of all rules asked) that hold there. All
relations between nodes are Spark's work:

* a node lies inside another that fits if the largest ``last`` of fitting nodes that begin
  before it reaches its own number, and has one within it if the next fitting ``pre`` isn't
  beyond its ``last``: running extremes over a file's nodes, without pairs. Windows hold a cell
  of ``CELL`` numbers; what comes from other cells of a file is the extreme of their
  extremes. So a file of any size is shared out.
* parents, children and siblings meet by equality.

Rules have the keys ``kind``, ``pattern``, ``regex``, ``all``, ``any``, ``not``, ``matches`` (a
rule of ``utils`` by name), ``inside``, ``has``, ``follows`` and ``precedes``; the last four look at the
parent, children or next siblings only, and with ``stopBy: end`` at all ancestors,
descendants or siblings. Python is read by its own parser and has the kinds of
``PYTHON_KINDS``, other nodes the names of its classes; scripts have brackets (``block``,
``parentheses``, ``brackets``) and the kinds of ``SCRIPT_KINDS``; pages (``html``) have their tags.
A place that a pattern matches and that is no node becomes one, of no kind.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import paths
from corpuscle.operators import match
from corpuscle.operators.kept import stored
from corpuscle.operators.scan_script import _matches, tokens

SCHEMA = "path string, pre int, last int, parent int, nth int, kind string, line int, col int, end_line int, text string, atoms array<int>"
#: Node numbers of one window.
CELL = 1 << 16
RELATIONS = ("inside", "has", "follows", "precedes")
#: Suffixes of each language.
SUFFIXES = {"python": (".py",), "script": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"), "html": (".html", ".htm")}
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KIND_OF = {name: kind for kind, names in match.PYTHON_KINDS.items() for name in names}
_BRACKETS = {"{": "block", "(": "parentheses", "[": "brackets"}

Span = tuple[int, int, str]  # first character, end, kind
Atom = tuple[str, str]  # kind, pattern or regex, and its value


def language_of(name: str) -> str:
    """The reader of a language's name."""
    low = name.lower()
    if low in ("python", "py"):
        return "python"
    return "html" if low in ("html", "htm") else "script"


def _python_spans(source: str) -> list[Span]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, starts, at = source.splitlines(keepends=True), [], 0
    for line in lines:
        starts.append(at)
        at += len(line)

    def place(row: int, column: int) -> int:
        return starts[row - 1] + (column if lines[row - 1].isascii() else len(lines[row - 1].encode()[:column].decode(errors="ignore")))

    out, below = [], [tree]
    while below:  # not by recursion, and each node after the one around it
        node = below.pop()
        if hasattr(node, "lineno") and node.end_lineno is not None:
            out.append((place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), _KIND_OF.get(type(node).__name__, type(node).__name__)))
        below += reversed(list(ast.iter_child_nodes(node)))
    return out


def _script_spans(source: str, kinds: set[str]) -> list[Span]:
    code = [t for t in tokens(source) if t.kind != "comment"]
    out = [(code[i].at, code[j].at + 1, _BRACKETS[code[i].text]) for i, j in _matches(code).items()]
    for kind in sorted(kinds & match.SCRIPT_KINDS.keys()):
        out += sorted({(a, b, kind) for p in match.SCRIPT_KINDS[kind] for a, b, _ in match.find(source, match.parse(p), False)})
    return out


class _Elements(HTMLParser):
    """Spans of a page's elements; one that isn't closed ends with the element around it."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.starts, at = [], 0
        for line in source.split("\n"):
            self.starts.append(at)
            at += len(line) + 1
        self.spans: list[Span] = []
        self.open: list[tuple[str, int]] = []
        self.count: dict[str, int] = {}
        self.feed(source)
        self.close()
        self._close(0, len(source))

    def _here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _close(self, depth: int, end: int) -> None:
        while len(self.open) > depth:
            tag, start = self.open.pop()
            self.count[tag] -= 1
            self.spans.append((start, end, tag))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        start = self._here()
        if tag in _VOID:
            self.spans.append((start, start + len(self.get_starttag_text() or ""), tag))
        else:
            self.open.append((tag, start))
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        start = self._here()
        self.spans.append((start, start + len(self.get_starttag_text() or ""), tag))

    def handle_endtag(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        start = self._here()
        end = self.rawdata.find(">", start) + 1 or len(self.rawdata)
        while self.open[-1][0] != tag:
            self._close(len(self.open) - 1, start)
        self._close(len(self.open) - 1, end)


def spans(source: str, language: str, kinds: set[str]) -> list[Span]:
    """All nodes of a file."""
    if language == "python":
        return _python_spans(source)
    return _Elements(source).spans if language == "html" else _script_spans(source, kinds)


def nested(found: list[Span]) -> list[tuple[int, int, int, int]]:
    """(pre, last, parent, nth) of each span, numbered by beginning and, of equal ones, from the outermost; parent -1 at the top.

    Of spans that cross, the later one counts as a child of what holds it whole.
    """
    order = sorted(range(len(found)), key=lambda i: (found[i][0], -found[i][1]))
    parent, children = [-1] * len(found), {}
    stack: list[int] = []
    for i in order:
        start, stop, _ = found[i]
        while stack and (found[stack[-1]][1] <= start < stop or found[stack[-1]][1] < stop):
            stack.pop()
        parent[i] = stack[-1] if stack else -1
        children.setdefault(parent[i], []).append(i)
        stack.append(i)
    out, number = [(0, 0, -1, 0)] * len(found), 0
    below = [(i, nth, -1) for nth, i in reversed(list(enumerate(children.get(-1, ()))))]
    pre = [0] * len(found)
    ends: list[int] = []
    while below:
        i, nth, up = below.pop()
        pre[i] = number
        out[i] = (number, number, up, nth)
        ends.append(i)
        below += [(c, k, number) for k, c in reversed(list(enumerate(children.get(i, ()))))]
        number += 1
    last = {out[i][0]: out[i][0] for i in ends}
    for i in reversed(ends):  # a node's end is known before that of the node around it
        own, up = out[i][0], out[i][2]
        if up >= 0:
            last[up] = max(last[up], last[own])
    return [(p, last[p], up, nth) for p, _, up, nth in out]


def atoms_of(rule: dict, utils: dict[str, dict]) -> list[Atom]:
    """The plain conditions of a rule and of all rules within it; an unknown key or kind is an error."""
    out: list[Atom] = []

    def walk(r: dict, seen: tuple[str, ...]) -> None:
        for key, value in r.items():
            if key in ("kind", "pattern", "regex"):
                out.append((key, str(value)))
            elif key in ("all", "any"):
                for part in value:
                    walk(part, seen)
            elif key in ("not", *RELATIONS):
                walk(value, seen)
            elif key == "matches":
                if value not in utils or value in seen:
                    raise ValueError(f"unknown or circular rule {value}")
                walk(utils[value], (*seen, value))
            elif key != "stopBy" or value not in ("end", "neighbor"):
                raise ValueError(f"a rule has no {key} {value if key == 'stopBy' else ''}".rstrip())

    walk(rule, ())
    return list(dict.fromkeys(out))


def positive(rule: dict, utils: dict[str, dict]) -> bool:
    """Whether only nodes of some kind or pattern can fit."""
    if "kind" in rule or "pattern" in rule:
        return True
    if "any" in rule and all(positive(r, utils) for r in rule["any"]):
        return True
    return any(positive(r, utils) for r in rule.get("all", ())) or "matches" in rule and positive(utils.get(rule["matches"], {}), utils)


def loose(rule: dict, utils: dict[str, dict]) -> bool:
    """Whether nodes without a kind or pattern asked for can fit a rule within this one."""
    parts = [*rule.get("all", ()), *rule.get("any", ()), *([rule["not"]] if "not" in rule else ()), *([utils[rule["matches"]]] if "matches" in rule else ())]
    return any(not positive(rule[r], utils) or loose(rule[r], utils) for r in RELATIONS if r in rule) or any(loose(r, utils) for r in parts)


def syntax_nodes(files: DataFrame, language: str, atoms: list[Atom], every: bool = True, constraints: dict[str, dict] | None = None, texts: bool = True) -> DataFrame:
    """Rows of nodes of each file of a language; without ``every`` only those where one of ``atoms`` holds, which alone have ``text``.

    ``constraints``: for metavariables of patterns a ``regex`` that their text has to hold.
    Without ``texts`` no node has ``text``: texts of nested nodes repeat those within them.
    """
    bounds = {}
    for name, test in (constraints or {}).items():
        if test.keys() != {"regex"}:
            raise ValueError(f"the constraint of {name} has to be a regex")
        bounds[name] = re.compile(str(test["regex"]))
    reader = language_of(language)
    kinds = {v for k, v in atoms if k == "kind"}
    known = {"python": match.PYTHON_KINDS.keys(), "script": match.SCRIPT_KINDS.keys() | set(_BRACKETS.values())}.get(reader)
    for kind in kinds:
        if known is not None and kind not in known and not (reader == "python" and hasattr(ast, kind)):
            raise ValueError(f"unknown kind {kind}")
    patterns = [(i, match.parse(v, reader == "python")) for i, (k, v) in enumerate(atoms) if k == "pattern"]
    by_kind: dict[str, list[int]] = {}
    for i, (k, v) in enumerate(atoms):
        if k == "kind":
            by_kind.setdefault(v, []).append(i)
    tests = [(i, re.compile(v)) for i, (k, v) in enumerate(atoms) if k == "regex"]

    def rows_of(path: str, source: str) -> list[tuple]:
        found = spans(source, reader, kinds)
        inner: dict[tuple[int, int], int] = {}
        for i, (a, b, _) in enumerate(found):
            inner[a, b] = i  # of equal spans the one read last, which is the innermost
        held: dict[int, list[int]] = {}
        for number, pattern in patterns:
            for a, b, bound in match.find(source, pattern, reader == "python"):
                if not all(test.search(bound.get(name, "")) for name, test in bounds.items() if name in bound):
                    continue
                if (a, b) not in inner:
                    inner[a, b] = len(found)
                    found.append((a, b, ""))
                held.setdefault(inner[a, b], []).append(number)
        lines, out = [-1, *(m.start() for m in re.finditer("\n", source))], []
        for i, ((a, b, kind), place) in enumerate(zip(found, nested(found), strict=True)):
            holds = [*by_kind.get(kind, ()), *held.get(i, ())]
            if holds or every:
                holds += [n for n, p in tests if p.search(source[a:b])]
            elif not holds:
                continue
            line = bisect_left(lines, a)
            out.append((path, *place, kind, line, a - lines[line - 1], bisect_left(lines, b), source[a:b] if holds and texts else None, sorted(holds)))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            for path, source in zip(frame["path"], frame["text"].fillna(""), strict=True):
                rows = rows_of(path, source)
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.where(F.lower(paths.suffix(F.col("path"))).isin(*SUFFIXES[reader])).select("path", "text").mapInPandas(run, SCHEMA)


def _cells(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_cell", F.floor(F.col("pre") / CELL).cast("int"))


def related(nodes: DataFrame, fits: str, relation: str, far: bool, out: str) -> DataFrame:
    """``nodes`` with ``out``: whether a node that ``fits`` (a boolean column) stands in ``relation`` to it."""
    if relation in ("inside", "has") and far:
        inside = relation == "inside"
        rows = _cells(nodes)
        value = F.when(F.col(fits), F.col("last") if inside else F.col("pre"))
        best = F.max if inside else F.min
        order = [F.asc("pre") if inside else F.desc("pre")]
        within = Window.partitionBy("path", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        cells = rows.groupBy("path", "_cell").agg(best(value).alias("_m"))
        beyond = Window.partitionBy("path").orderBy(F.asc("_cell") if inside else F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
        carried = cells.select("path", "_cell", best("_m").over(beyond).alias("_from"))
        reach = (F.greatest if inside else F.least)(best(value).over(within), F.col("_from"))
        rows = rows.join(carried, ["path", "_cell"]).withColumn("_reach", reach)
        holds = F.col("_reach") >= F.col("pre") if inside else F.col("_reach") <= F.col("last")
        return rows.withColumn(out, F.coalesce(holds, F.lit(False))).drop("_cell", "_from", "_reach")
    some = nodes.where(F.col(fits))
    if relation == "inside":
        key, other = ["path", "parent"], some.select("path", F.col("pre").alias("parent"))
    elif relation == "has":
        key, other = ["path", "pre"], some.select("path", F.col("parent").alias("pre")).distinct()
    else:
        ahead = relation == "follows"  # the other one stands before
        if not far:
            key, other = ["path", "parent", "nth"], some.select("path", "parent", (F.col("nth") + (1 if ahead else -1)).alias("nth"))
        else:
            edge = (F.min if ahead else F.max)("nth").alias("_edge")
            rows = nodes.join(some.groupBy("path", "parent").agg(edge), ["path", "parent"], "left")
            holds = F.col("_edge") < F.col("nth") if ahead else F.col("_edge") > F.col("nth")
            return rows.withColumn(out, F.coalesce(holds, F.lit(False))).drop("_edge")
    return nodes.join(other.withColumn(out, F.lit(True)), key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def fitting(nodes: DataFrame, rules: list[dict], atoms: list[Atom], utils: dict[str, dict], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``nodes`` with a boolean column ``r0``, ``r1``, ... for each rule; ``keep`` materialises the rows between relations."""
    numbers, made = {a: i for i, a in enumerate(atoms)}, 0

    def column(r: dict) -> Column:
        nonlocal nodes, made
        parts = [F.array_contains("atoms", numbers[k, str(r[k])]) for k in ("kind", "pattern", "regex") if k in r]
        parts += [column(x) for x in r.get("all", ())]
        if "any" in r:
            parts.append(reduce(lambda a, b: a | b, [column(x) for x in r["any"]], F.lit(False)))
        if "not" in r:
            parts.append(~column(r["not"]))
        if "matches" in r:
            parts.append(column(utils[r["matches"]]))
        for relation in RELATIONS:
            if relation in r:
                inner = column({k: v for k, v in r[relation].items() if k != "stopBy"})
                nodes = keep(nodes) if made else nodes  # each relation reads its input twice
                made += 1
                fits, out = f"_f{made}", f"_r{made}"
                nodes = nodes.withColumn(fits, inner)
                nodes = related(nodes, fits, relation, r[relation].get("stopBy") == "end", out).drop(fits)
                parts.append(F.col(out))
        return reduce(lambda a, b: a & b, parts)

    columns = [column(r) for r in rules]
    return nodes.select("*", *(c.alias(f"r{i}") for i, c in enumerate(columns)))


def rules_matches(files: DataFrame, rules: list[tuple[str, dict]], language: str, utils: dict[str, dict] | None = None, constraints: dict[str, dict] | None = None, texts: bool = True) -> DataFrame:
    """(rule, path, line, col, end_line, text): where each of several named rules holds; files are read once for all.

    Without ``texts`` the column text is null, and no text is written between relations. A rule needs a kind, a pattern, or such rules in ``any`` or ``all``; else it is an error.
    """
    utils = utils or {}
    atoms = list(dict.fromkeys(a for _, r in rules for a in atoms_of(r, utils)))
    if not all(positive(r, utils) for _, r in rules):
        raise ValueError("a rule needs a pattern, a kind, any or all")
    nodes = stored(syntax_nodes(files, language, atoms, any(loose(r, utils) for _, r in rules), constraints, texts))
    found = fitting(nodes, [r for _, r in rules], atoms, utils, stored)
    names = F.array_compact(F.array(*(F.when(F.col(f"r{i}"), F.lit(name)) for i, (name, _) in enumerate(rules))))
    return found.select(F.explode(names).alias("rule"), "path", "line", "col", "end_line", "text")


def rule_matches(files: DataFrame, rule: dict, language: str, utils: dict[str, dict] | None = None, constraints: dict[str, dict] | None = None) -> DataFrame:
    """(path, line, col, end_line, text, bindings) of the places where a rule holds; ``bindings`` is empty."""
    return rules_matches(files, [("rule", rule)], language, utils, constraints).select("path", "line", "col", "end_line", "text", F.lit("{}").alias("bindings"))
