"""Rules over nested sets give what a walk over the tree gives."""

import random
import re

import pytest

from corpuscle.operators import match, trees
from corpuscle.plans import syntax
from corpuscle.sources.tables import table


class Node:
    def __init__(self, span, parent):
        self.span, self.parent, self.children = span, parent, []


def walked(source, language, rule, utils):
    """Places where a rule holds, by a walk for each node."""
    found = trees.spans(source, language, {v for k, v in trees.atoms_of(rule, utils) if k == "kind"})
    have = {(a, b) for a, b, _ in found}
    hits = {}
    for k, v in trees.atoms_of(rule, utils):
        if k == "pattern":
            for a, b, _ in match.find(source, match.parse(v, language == "python"), language == "python"):
                hits.setdefault((a, b), set()).add(v)
                if (a, b) not in have:
                    have.add((a, b))
                    found.append((a, b, ""))
    inner = {(a, b): i for i, (a, b, _) in enumerate(found)}
    nodes = [Node(s, None) for s in found]
    order = sorted(range(len(found)), key=lambda i: (found[i][0], -found[i][1]))
    for at, i in enumerate(order):
        around = [j for j in order[:at] if found[j][0] <= found[i][0] and found[i][1] <= found[j][1] and not (found[j][1] <= found[i][0] < found[i][1])]
        # the last one that no later crossing node has closed
        open_ = []
        for j in order[:at]:
            while open_ and (found[open_[-1]][1] <= found[j][0] < found[j][1] or found[open_[-1]][1] < found[j][1]):
                open_.pop()
            open_.append(j)
        around = [j for j in open_ if j in around]
        if around:
            nodes[i].parent = nodes[around[-1]]
            nodes[around[-1]].children.append(nodes[i])
    top = [n for n in (nodes[i] for i in order) if n.parent is None]

    def holds(n, r):
        a, b, kind = n.span
        around = n.parent.children if n.parent else top
        place = around.index(n)
        ok = all((k != "kind" or kind == v) and (k != "regex" or re.search(v, source[a:b])) and (k != "pattern" or v in hits.get((a, b), ()) and nodes[inner[a, b]] is n) for k, v in r.items() if k in ("kind", "regex", "pattern"))
        ok = ok and all(holds(n, x) for x in r.get("all", ())) and ("any" not in r or any(holds(n, x) for x in r["any"])) and not ("not" in r and holds(n, r["not"]))
        ok = ok and ("matches" not in r or holds(n, utils[r["matches"]]))
        for relation in trees.RELATIONS:
            if ok and relation in r:
                sub, far = {k: v for k, v in r[relation].items() if k != "stopBy"}, r[relation].get("stopBy") == "end"
                if relation == "inside":
                    others, x = [], n.parent
                    while x:
                        others.append(x)
                        x = x.parent
                elif relation == "has":
                    others = list(n.children)
                    for x in others:
                        if far:
                            others += x.children
                else:
                    others = around[:place][::-1] if relation == "follows" else around[place + 1 :]
                if relation != "has" and not far:
                    others = others[:1]
                ok = any(holds(x, sub) for x in others)
        return bool(ok)

    return sorted(n.span[:2] for n in nodes if holds(n, rule))


PYTHON = ["def run(x):\n    return helper(x)\n\n\nclass A:\n    def go(self):\n        for i in [1]:\n            if i:\n                print(helper(1), [helper(y) for y in x])\n        helper(2)\n    é = helper('ü')\n\n\nhelper(2)\n", "def broken(:\n", "", "x = f(g(h(1)))\n"]
RULES = [
    {"kind": "call"},
    {"kind": "call", "inside": {"kind": "class_definition", "stopBy": "end"}},
    {"kind": "call", "inside": {"kind": "call"}},
    {"kind": "function_definition", "has": {"pattern": "helper($A)", "stopBy": "end"}},
    {"kind": "function_definition", "has": {"kind": "return_statement"}, "not": {"inside": {"kind": "class_definition"}}},
    {"any": [{"pattern": "helper(2)"}, {"kind": "if_statement"}], "inside": {"any": [{"kind": "for_statement"}, {"regex": "^class"}], "stopBy": "end"}},
    {"all": [{"kind": "call"}, {"regex": "[12]"}, {"not": {"has": {"kind": "call", "stopBy": "end"}}}]},
    {"kind": "call", "inside": {"not": {"kind": "call"}}},
    {"kind": "Expr", "has": {"pattern": "helper($A)"}, "follows": {"kind": "for_statement", "stopBy": "end"}},
    {"kind": "for_statement", "precedes": {"regex": "helper"}},
    {"matches": "loop", "has": {"kind": "if_statement", "has": {"matches": "called", "stopBy": "end"}}},
]
UTILS = {"loop": {"kind": "for_statement"}, "called": {"pattern": "helper($$$A)"}}


def places(spark, sources, rules, language, utils):
    suffix = {"python": "py", "html": "html", "script": "ts"}[language]
    files = spark.createDataFrame([(f"{i}.{suffix}", s) for i, s in enumerate(sources)], "path string, text string")
    out = {}
    for r in trees.rules_matches(files, [(str(n), rule) for n, rule in enumerate(rules)], language, utils).collect():
        i = int(r.path.split(".")[0])
        lines = sources[i].split("\n")
        start = sum(len(x) + 1 for x in lines[: r.line - 1]) + r.col - 1
        assert sources[i][start : start + len(r.text)] == r.text and r.end_line == r.line + r.text.count("\n")
        out.setdefault((int(r.rule), i), []).append((start, start + len(r.text)))
    return {k: sorted(v) for k, v in out.items()}


def test_against_a_walk(spark, monkeypatch):
    want = {(n, i): walked(s, "python", r, UTILS) for n, r in enumerate(RULES) for i, s in enumerate(PYTHON)}
    want = {k: v for k, v in want.items() if v}
    assert {n for n, _ in want} == set(range(len(RULES)))
    assert places(spark, PYTHON, RULES, "python", UTILS) == want
    monkeypatch.setattr(trees, "CELL", 3)
    assert places(spark, PYTHON, RULES, "python", UTILS) == want


def test_pages_against_a_walk(spark, monkeypatch):
    pages = [r.html or "" for r in table(spark, "/root/testdata/sf0.001", "pages").orderBy("page_id").limit(12).collect()]
    pages += ["<div><p>a<p>b</div></p><br><ul><li>x<li><b>y</ul>", "text only", "<div>" * 40 + "<p>deep"]
    rules = [r for _, r in syntax.PAGE_RULES]
    want = {(n, i): walked(s, "html", r, {}) for n, r in enumerate(rules) for i, s in enumerate(pages)}
    monkeypatch.setattr(trees, "CELL", 7)
    assert places(spark, pages, rules, "html", {}) == {k: v for k, v in want.items() if v}


def test_random_spans():
    rng = random.Random(4)
    for _ in range(200):
        found = []
        for _ in range(rng.randint(0, 14)):
            a, b = sorted((rng.randint(0, 12), rng.randint(0, 12)))
            found.append((a, b, "x"))
        placed = trees.nested(found)
        assert sorted(p for p, *_ in placed) == list(range(len(found)))
        by = {p: (last, up, nth, i) for i, (p, last, up, nth) in enumerate(placed)}
        for p, (last, up, _, i) in by.items():
            below = [q for q in by if q != p and _is_below(by, q, p)]
            assert last == max([p, *below]) and sorted(below) == list(range(p + 1, last + 1))
            if up >= 0:
                a, b, _ = found[by[up][3]]
                assert a <= found[i][0] and found[i][1] <= b


def _is_below(by, q, p):
    while q >= 0:
        q = by[q][1]
        if q == p:
            return True
    return False


def test_constraints_and_broken_rules(spark):
    files = spark.createDataFrame([("a.py", PYTHON[0]), ("b.py", None)], "path string, text string")
    rows = trees.rule_matches(files, {"pattern": "helper($A)"}, "python", constraints={"A": {"regex": "^[0-9]$"}})
    assert sorted(r.line for r in rows.collect()) == [9, 10, 14]
    for rule, utils, bounds in (({}, {}, {}), ({"kind": "no_such"}, {}, {}), ({"has": {"kind": "call"}}, {}, {}), ({"kind": "call", "field": "x"}, {}, {}), ({"matches": "a"}, {"a": {"matches": "a"}}, {}), ({"kind": "call"}, {}, {"A": {"kind": "call"}}), ({"kind": "call", "inside": {"kind": "call", "stopBy": "far"}}, {}, {})):
        with pytest.raises(ValueError):
            trees.rule_matches(files, rule, "python", utils, bounds)


def test_rules_without_texts(spark):
    """Without texts the same places are found, and no text is written or returned."""
    page = "<article><p>One</p><div><p>Two</p></div></article>"
    files = spark.createDataFrame([("a.html", page)], "path string, text string")
    rules = [("inner", {"kind": "p", "inside": {"kind": "article", "stopBy": "end"}}), ("boxes", {"kind": "div", "has": {"kind": "p"}})]
    places = lambda texts: sorted((r.rule, r.line, r.col, r.text) for r in trees.rules_matches(files, rules, "html", texts=texts).collect())
    assert places(True) == [("boxes", 1, 20, "<div><p>Two</p></div>"), ("inner", 1, 10, "<p>One</p>"), ("inner", 1, 25, "<p>Two</p>")]
    assert places(False) == [(rule, line, col, None) for rule, line, col, _ in places(True)]
