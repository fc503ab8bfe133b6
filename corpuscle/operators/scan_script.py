"""Facts of one TypeScript or JavaScript file, from a tokenizer and brace depth.

Covered: imports and requires, exports and re-exports, classes with heritage, functions,
methods, arrow and field functions, plain variables, calls with their owner, leading
comments. Not covered: names inside destructuring (left out on purpose), decorators'
arguments, conditional types. Files over ``SURFACE_BYTES`` give only what their top
level imports and exports.
"""

from __future__ import annotations

import re

from corpuscle.operators.scan_python import Fact

SURFACE_BYTES = 256 * 1024

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<template>`(?:[^`\\]|\\.)*`?)"""
    r"""|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<arrow>=>)|(?P<sign>\.\.\.|\?\.|[{}()\[\];,<>=:.?!&|+\-*/%^~@#])""",
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
# Words that are no function or call names.
WORDS = frozenset("if for while switch catch return typeof await function new delete void in of do else case throw yield super import require constructor instanceof with".split())


class Token(tuple):
    kind = property(lambda s: s[0])
    text = property(lambda s: s[1])
    line = property(lambda s: s[2])
    at = property(lambda s: s[3])


def tokens(source: str) -> list[Token]:
    """Tokens without white space; a slash begins a regular expression where no value stands before it."""
    out, at, line = [], 0, 1
    while at < len(source):
        before = next((t for t in reversed(out) if t.kind != "comment"), None)
        value = before is not None and (before.kind in ("number", "string", "template") or before.kind == "name" and before.text not in WORDS or before.text in (")", "]", "}"))
        m = REGEX.match(source, at) if source[at] == "/" and not value else None
        kind = "regex" if m else None
        m = m or TOKEN.match(source, at)
        if m is None:
            at += 1
            continue
        kind = kind or m.lastgroup
        if kind != "space":
            out.append(Token((kind, m[0], line, at)))
        line += m[0].count("\n")
        at = m.end()
    return out


def _matches(code: list[Token]) -> dict[int, int]:
    """The closing token of each opening one."""
    out, stack = {}, []
    for i, t in enumerate(code):
        if t.text in ("{", "(", "[") and t.kind == "sign":
            stack.append(i)
        elif t.text in ("}", ")", "]") and t.kind == "sign" and stack:
            out[stack.pop()] = i
    return out


def scan(source: str) -> list[Fact]:
    """All facts of a file."""
    all_tokens = tokens(source)
    code = [t for t in all_tokens if t.kind != "comment"]
    close = _matches(code)
    surface = len(source.encode()) > SURFACE_BYTES
    text = lambda i: code[i].text if 0 <= i < len(code) else ""
    name = lambda i: text(i) if 0 <= i < len(code) and code[i].kind == "name" else ""
    facts: list[Fact] = []
    scopes: list[tuple[int, int, str]] = []  # (first token, last token, name) of functions, anonymous ones included
    bodies: dict[int, str] = {}  # the class whose body begins at a token

    def body_after(i: int) -> int | None:
        """The opening brace of a function's body, after its parameters and return type."""
        depth = 0
        while i < len(code):
            t = text(i)
            if t == "{" and not depth and text(i - 1) not in (":", "|", "&", "<"):
                return i
            if t in (";", "}") and not depth or t == "," and not depth:
                return None
            if t in ("{", "(", "["):
                i = close.get(i, len(code))
            i += 1
        return None

    def function(i: int, label: str, start: int, params: int, exported: bool) -> None:
        end = close.get(params)
        if end is None:
            return
        k = end + 1
        arrow = None
        if text(k) == "=>":
            arrow = k
        elif text(k) == ":":
            j = k + 1
            while j < len(code) and text(j) not in ("=>", "{", ";", ",", ")") or text(j) == "{" and text(j - 1) == ":":
                j = close.get(j, j) + 1
            arrow = j if text(j) == "=>" else None
        if arrow is not None and text(arrow + 1) != "{":
            last, depth = arrow + 1, 0
            while last < len(code) and not (text(last) in (",", ";", ")", "]", "}")):
                if text(last) in ("{", "(", "["):
                    last = close.get(last, len(code) - 1)
                last += 1
                if last < len(code) and code[last].line > code[last - 1].line and text(last) not in (".", "?", ":", "?.", "&", "|", "+") and text(last - 1) not in (".", "?", ":", "&", "|", "+", "=>", "("):
                    break
            last -= 1
            scopes.append((arrow + 1, last, label))
        else:
            opening = arrow + 1 if arrow is not None else body_after(end + 1)
            last = close.get(opening, len(code) - 1) if opening is not None else end
            if opening is not None:
                scopes.append((opening, last, label))
        if label:
            facts.append(("function", label, label, code[start].line, code[min(last, len(code) - 1)].line - code[start].line + 1, "", "exported" if exported else ""))

    def depth_of(i: int) -> int:
        return depths[i]

    depths, d = [], 0
    for t in code:
        if t.kind == "sign" and t.text in ("}", ")", "]"):
            d -= 1
        depths.append(d)
        if t.kind == "sign" and t.text in ("{", "(", "["):
            d += 1
    top = lambda i: depth_of(i) == 0

    for i, t in enumerate(code):
        if t.kind != "name":
            if t.text == "=>" and t.kind == "arrow" and not surface:  # an anonymous arrow function
                if text(i - 1) == ")":
                    start = next((k for k, v in close.items() if v == i - 1), i)
                    if text(start - 1) not in ("=", "async") or True:
                        if not any(s[0] == i + 1 for s in scopes):
                            function(i, "", start, start, False)
                elif name(i - 1) and text(i + 1) == "{":
                    scopes.append((i + 1, close.get(i + 1, len(code) - 1), ""))
                elif name(i - 1):
                    last = i + 1
                    while last < len(code) and text(last) not in (",", ";", ")", "]", "}"):
                        last = close.get(last, last) + 1
                    scopes.append((i + 1, last - 1, ""))
            continue
        exported = text(i - 1) == "export" or text(i - 2) == "export" and text(i - 1) in ("default", "async", "declare", "abstract", "const") or text(i - 3) == "export"
        if t.text == "import" and text(i + 1) != "(" and text(i + 1) != "." and top(i):
            j = i + 1
            while j < len(code) and code[j].kind != "string" and text(j) != ";":
                j += 1
            if j < len(code) and code[j].kind == "string":
                facts.append(("import", text(j)[1:-1], text(j)[1:-1], t.line, 1, "", "import"))
        elif t.text in ("require", "import") and text(i + 1) == "(" and i + 2 < len(code) and code[i + 2].kind == "string":
            facts.append(("import", text(i + 2)[1:-1], text(i + 2)[1:-1], t.line, 1, "", "require" if t.text == "require" else "import"))
        elif t.text == "export" and text(i + 1) in ("{", "*") and top(i) or t.text == "export" and text(i + 1) == "type" and text(i + 2) == "{":
            j = i + 1 + (text(i + 1) == "type")
            if text(j) == "*":
                alias = name(j + 2) if text(j + 1) == "as" else ""
                k = j + 1 + 2 * bool(alias)
                if text(k) == "from":
                    facts.append(("reexport", alias or "*", text(k + 1)[1:-1], t.line, 1, "", "*"))
                    if alias:
                        facts.append(("export", alias, alias, t.line, 1, "", ""))
                continue
            end = close.get(j, j)
            target = text(end + 2)[1:-1] if text(end + 1) == "from" else None
            k = j + 1
            while k < end:
                if text(k) == "type" and name(k + 1) and text(k + 1) != "as":
                    k += 1
                imported = text(k)
                public = text(k + 2) if text(k + 1) == "as" else imported
                facts.append(("export", public, public, t.line, 1, "", ""))
                if target is not None:
                    facts.append(("reexport", public, target, t.line, 1, "", imported))
                while k < end and text(k) != ",":
                    k += 1
                k += 1
        elif t.text == "class" and (name(i + 1) or text(i + 1) == "{") and text(i - 1) not in (".", "?."):
            label = name(i + 1) if name(i + 1) not in ("extends", "implements") else ""
            j = i + 1
            while j < len(code) and text(j) != "{":
                if text(j) in ("extends", "implements"):
                    facts.append(("base", name(j + 1), label, code[j].line, 1, "", text(j)))
                j += 1
            bodies[j] = label
            if label:
                facts.append(("class", label, label, t.line, code[close.get(j, len(code) - 1)].line - t.line + 1, "", "exported" if exported else ""))
                if exported and top(i):
                    facts.append(("export", label, label, t.line, 1, "", ""))
        elif t.text in ("interface", "type", "enum", "namespace") and name(i + 1) and exported and top(i):
            facts.append(("export", name(i + 1), name(i + 1), t.line, 1, "", t.text))
        elif t.text == "function" and text(i - 1) not in (".", "?."):
            j = i + 1 + (text(i + 1) == "*")
            label = name(j)
            params = j + bool(label)
            while text(params) != "(" and params < len(code):
                params += 1
            bound = name(i - 2) if text(i - 1) == "=" else name(i - 3) if text(i - 2) == "=" and text(i - 1) == "async" else ""
            if not surface:
                function(i, bound or label, i, params, exported)
            if exported and label and top(i):
                facts.append(("export", label, label, t.line, 1, "", ""))
        elif t.text in ("const", "let", "var") and name(i + 1) and text(i + 1) not in ("enum",):
            j = i + 1
            while name(j):
                k = j + 1
                if text(k) == ":":
                    while k < len(code) and text(k) not in ("=", ";", ","):
                        k = close.get(k, k) + 1
                value = k + 1 + (text(k + 1) == "async")
                is_function = text(k) == "=" and (text(value) == "function" or text(value) == "(" and _arrow_after(code, close, value) or name(value) and text(value + 1) == "=>")
                if exported and top(i):
                    facts.append(("export", name(j), name(j), code[j].line, 1, "", ""))
                if is_function and not surface:
                    if text(value) == "(":
                        function(j, name(j), j, value, exported)
                    elif name(value) and text(value + 1) == "=>":
                        start = value + 2
                        last = close.get(start, start) if text(start) == "{" else start
                        while text(start) != "{" and last + 1 < len(code) and text(last + 1) not in (",", ";", ")", "]", "}") and code[last + 1].line == code[last].line:
                            last = close.get(last + 1, last + 1)
                        scopes.append((start, last, name(j)))
                        facts.append(("function", name(j), name(j), code[j].line, code[last].line - code[j].line + 1, "", "exported" if exported else ""))
                elif not is_function and not surface:
                    facts.append(("variable", name(j), name(j), code[j].line, 1, "", "module" if top(i) else "local"))
                while k < len(code) and text(k) not in (",", ";") and not (code[k].line > code[k - 1].line and depth_of(k) <= depth_of(i) and text(k) not in (".", "?", ":", "=")):
                    k = close.get(k, k) + 1
                if text(k) != ",":
                    break
                j = k + 1
        elif text(i + 1) == "(" and not surface and t.text not in WORDS | {"constructor"} - {"constructor"}:
            end = close.get(i + 1)
            owner_body = next((k for k in sorted(bodies, reverse=True) if k < i and depth_of(i) == depth_of(k) + 1 and close.get(k, len(code)) > i), None)
            after = text(end + 1) if end is not None else ""
            if owner_body is not None and after in ("{", ":") and text(i - 1) not in (".", "?.", "=", "(", "new"):
                start = i
                while text(start - 1) in ("async", "static", "public", "private", "protected", "override", "get", "set", "*", "abstract", "readonly"):
                    start -= 1
                function(i, t.text, start, i + 1, False)
            elif text(i - 1) != "function":
                facts.append(("call", t.text, t.text, t.line, 1, "", f"{name(i - 2)}.{t.text}" if text(i - 1) in (".", "?.") and name(i - 2) else t.text))
                facts[-1] = (*facts[-1][:5], str(i), facts[-1][6])
    out = []
    for fact in facts:
        if fact[0] == "call":
            i = int(fact[5])
            holders = [s for s in scopes if s[0] <= i <= s[1]]
            owner = min(holders, key=lambda s: s[1] - s[0])[2] if holders else ""
            if not owner:
                continue  # at top level, or in a function without a name
            fact = (*fact[:5], owner, fact[6])
        out.append(fact)
    return sorted(out, key=lambda f: f[3])


def _arrow_after(code: list[Token], close: dict[int, int], i: int) -> bool:
    """Whether the parentheses at ``i`` are an arrow function's parameters."""
    k = close.get(i)
    if k is None:
        return False
    k += 1
    if k < len(code) and code[k].text == ":":
        while k < len(code) and code[k].text not in ("=>", ";", ","):
            k = close.get(k, k) + 1
    return k < len(code) and code[k].text == "=>"


def documentation(source: str) -> list[tuple[str, str, str, str, int, str | None, str | None, str | None, str | None]]:
    """(kind, name, qualified name, parent, line, inputs, outputs, docstring, error): leading comments of a file and its definitions."""
    all_tokens, lines = tokens(source), source.split("\n")
    comments = [t for t in all_tokens if t.kind == "comment"]
    by_end = {t.line + t.text.count("\n"): t for t in comments if not lines[t.line - 1][: max(0, t.at - source.rfind("\n", 0, t.at) - 1)].strip()}

    def above(line: int) -> str | None:
        picked, at = [], line - 1
        while at in by_end:
            t = by_end[at]
            if t.text.startswith("/*") and picked:
                break
            picked.insert(0, t.text)
            at = t.line - 1
            if t.text.startswith("/*"):
                break
        return clean("\n".join(picked)) if picked else None

    first = next((t for t in all_tokens if t.kind != "comment"), None)
    head = comments[0] if comments and (first is None or comments[0].at < first.at) else None
    end = head.line + head.text.count("\n") if head is not None else 0
    is_file = head is not None and (first is None or first.line > end + 1 or head.text.startswith("/**") and any(t.line == end + 1 for t in comments[1:2]))
    out = [("file", "", "", "", 1, None, None, clean(head.text) if is_file else None, None)]
    spans = [f for f in scan(source) if f[0] in ("function", "class")]
    for kind, name, _, line, span, _, _ in spans:
        holders = [s for s in spans if s[0] in ("function", "class") and s[3] <= line and line + span <= s[3] + s[4] and s[3:5] != (line, span)]
        parents = [s[1] for s in sorted(holders, key=lambda s: -s[4])]
        inner = "method" if kind == "function" and holders and min(holders, key=lambda s: s[4])[0] == "class" else kind
        out.append((inner, name, ".".join([*parents, name]), ".".join(parents), line, None, None, above(line), None))
    return out


def clean(comment: str) -> str | None:
    """A comment without its marks; nothing of tool directives."""
    lines = [re.sub(r"^\s*(?:/\*\*?|\*/|\*(?!/)|//+)?\s?|\s*\*/\s*$", "", x) for x in comment.split("\n")]
    text = "\n".join(x.rstrip() for x in lines).strip()
    return None if not text or re.match(r"(eslint|prettier|ts-|@ts-|biome|istanbul|c8|v8|#region|#endregion|!)", text) else text
