"""Syntax patterns: token sequences with metavariables, found in source files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import paths
from corpuscle.operators.scan_script import Token, _matches, tokens

SCHEMA = "path string, line int, col int, end_line int, text string, bindings string"
_PY = re.compile(r"(?P<space>[^\S\n]+|\\\n|\n)|(?P<comment>#[^\n]*)|(?P<string>[rRbBuUfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?))|(?P<number>\d[\w.]*)|(?P<name>\w+)|(?P<sign>->|:=|\*\*|//|==|!=|<=|>=|.)")


def _tokens(source: str, python: bool) -> list[Token]:
    if not python:
        return [t for t in tokens(source) if t.kind != "comment"]
    out, line = [], 1
    for m in _PY.finditer(source):
        if m.lastgroup not in ("space", "comment"):
            out.append(Token((m.lastgroup, m[0], line, m.start())))
        line += m[0].count("\n")
    return out


def parse(pattern: str, python: bool = False) -> list[str]:
    """Tokens of a pattern; metavariables stay whole."""
    marked = re.sub(r"\$\$\$(\w*)", r" __many_\1 ", pattern)
    marked = re.sub(r"\$([A-Z_][A-Z0-9_]*)", r" __one_\1 ", marked)
    return [t.text for t in _tokens(marked, python)]


def find(source: str, pattern: list[str], python: bool) -> list[tuple[int, int, dict[str, str]]]:
    """(first character, end, bindings) of each place; a metavariable met twice must be the same text."""
    code = _tokens(source, python)
    close = _matches(code)
    out = []

    def at(i: int, k: int, bound: dict[str, str]) -> tuple[int, dict[str, str]] | None:
        if k == len(pattern):
            return i, bound
        want = pattern[k]
        if want.startswith("__many_"):
            j = i
            while True:
                hit = at(j, k + 1, bound | ({want[7:]: source[code[i].at : code[j - 1].at + len(code[j - 1].text)] if j > i else ""} if want[7:] else {}))
                if hit:
                    return hit
                if j >= len(code) or code[j].text in (")", "]", "}"):
                    return None
                j = close.get(j, j) + 1
        if i >= len(code):
            return None
        if want.startswith("__one_"):
            j = i
            if code[i].text in (")", "]", "}", ",", ";"):
                return None
            while True:  # an operand: a token, its members, calls and indexes
                j = close.get(j, j)
                value = source[code[i].at : code[j].at + len(code[j].text)]
                if bound.get(want[6:], value) == value:
                    hit = at(j + 1, k + 1, bound | {want[6:]: value})
                    if hit:
                        return hit
                if j + 1 < len(code) and code[j + 1].text in ("(", "["):
                    j += 1
                elif j + 2 < len(code) and code[j + 1].text in (".", "?."):
                    j += 2
                else:
                    return None
        return at(i + 1, k + 1, bound) if code[i].text == want else None

    for i in range(len(code)):
        if pattern and (pattern[0].startswith("__") or code[i].text == pattern[0]):
            hit = at(i, 0, {})
            if hit and hit[0] > i:
                last = code[hit[0] - 1]
                out.append((code[i].at, last.at + len(last.text), hit[1]))
    return out


#: Node kinds that a rule may name, by the classes of Python's own tree.
PYTHON_KINDS = {
    "assignment": ("Assign", "AnnAssign"), "call": ("Call",), "class_definition": ("ClassDef",), "for_statement": ("For", "AsyncFor"), "function_definition": ("FunctionDef", "AsyncFunctionDef"),
    "identifier": ("Name",), "if_statement": ("If",), "import_from_statement": ("ImportFrom",), "import_statement": ("Import",), "return_statement": ("Return",), "try_statement": ("Try",), "while_statement": ("While",),
    "with_statement": ("With", "AsyncWith"),
}
#: Patterns that stand for node kinds of scripts.
SCRIPT_KINDS = {
    "arrow_function": ("($$$) => { $$$ }", "($$$) => $A"), "call_expression": ("$F($$$)",), "class_declaration": ("class $N { $$$ }", "class $N extends $B { $$$ }"),
    "function_declaration": ("function $N($$$) { $$$ }", "function $N($$$): $T { $$$ }"), "import_statement": ("import $A from $B", "import { $$$ } from $B"), "return_statement": ("return $A",),
}

def match_json(row: dict) -> dict:
    """A match as a JSON record: ranges count lines and columns from 0, text output from 1."""
    last = row["text"].rpartition("\n")[2]
    column = row["col"] - 1 + len(row["text"]) if "\n" not in row["text"] else len(last)
    return {"path": row["path"], "text": row["text"], "range": {"start": {"line": row["line"] - 1, "column": row["col"] - 1}, "end": {"line": row["end_line"] - 1, "column": column}}}


def matches(files: DataFrame, pattern: str, language: str | None = None) -> DataFrame:
    """(path, line, col, end_line, text, bindings) of all places; files that lack a word of the pattern are dropped first."""
    import json

    words = [w for w in re.findall(r"\w+", re.sub(r"\$+\w*", " ", pattern)) if len(w) > 1]
    p = F.lower(paths.suffix(F.col("path")))
    known = [".py"] if language == "python" else [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"] if language else [".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
    some = files.where(p.isin(*known))
    for word in words:
        some = some.where(F.contains("text", F.lit(word)))
    forms = {python: parse(pattern, python) for python in (True, False)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, source in zip(frame["path"], frame["text"], strict=True):
                python = path.lower().endswith(".py")
                for start, end, bound in find(source or "", forms[python], python):
                    line = source.count("\n", 0, start) + 1
                    rows.append((path, line, start - source.rfind("\n", 0, start), line + source.count("\n", start, end), source[start:end], json.dumps(bound, sort_keys=True)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return some.select("path", "text").mapInPandas(run, SCHEMA)
