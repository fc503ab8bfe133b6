"""Output: budgets, fair truncation of JSON, headings and lists, score formats."""

from __future__ import annotations

import copy
import json
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from corpuscle.operators import payload

MOST_BYTES = 30_000


def fixed(value: float, digits: int = 2) -> float:
    """Rounded half up on the exact binary value, as printed figures are."""
    return float(Decimal(value).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def score(value: float) -> str:
    return f"{value:.3f}".rstrip("0").rstrip(".")


def percent(share: float) -> str:
    """One decimal at most; tiny shares as <0.1%, nearly all as 100%."""
    p = share * 100
    if 0 < p < 0.1:
        return "<0.1%"
    return "100%" if p >= 99.95 else f"{p:.1f}".rstrip("0").rstrip(".") + "%"


def text_within(text: str, most: int = MOST_BYTES) -> str:
    """Whole lines up to ``most`` bytes, and a line that says how many were left out."""
    if len(text.encode()) <= most:
        return text
    lines, kept, size = text.split("\n"), [], 0
    room = most - 80
    for line in lines:
        size += len(line.encode()) + 1
        if size > room:
            break
        kept.append(line)
    return "\n".join([*kept, f"... {len(lines) - len(kept)} more lines left out to stay within {most} bytes"])


def _bytes(value: Any) -> int:
    return len(json.dumps(value, ensure_ascii=False, indent=2).encode())


def _arrays(value: Any, path: tuple = ()) -> list[tuple]:
    """Places of arrays of rows; arrays inside rows are part of them."""
    if isinstance(value, list):
        return [path]
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in _arrays(v, (*path, k))]
    return []


def _at(value: Any, path: tuple) -> Any:
    for k in path:
        value = value[k]
    return value


def json_within(value: Any, most: int = MOST_BYTES) -> str:
    """Valid JSON of at most ``most`` bytes: arrays get one item each in turn while they fit, then texts shorten."""
    if _bytes(value) <= most:
        return json.dumps(value, ensure_ascii=False, indent=2)
    out, places = copy.deepcopy(value), _arrays(value)
    for path in places:
        if path:
            _at(out, path[:-1])[path[-1]] = []
    if places == [()]:
        out = []
    noted = {"data": out, "truncated": True} if not isinstance(out, dict) else out
    if isinstance(out, dict):
        out["truncated"] = True
    size, blocked, at = _bytes(noted), set(), 0
    while len(blocked) < len(places):
        for path in places:
            if path in blocked:
                continue
            source, target = _at(value, path), _at(out, path) if path else out
            if at >= len(source):
                blocked.add(path)
                continue
            depth = 2 * (len(path) + 1)
            need = sum(len(x.encode()) + depth + 1 for x in json.dumps(source[at], ensure_ascii=False, indent=2).split("\n")) + depth + 4
            if size + need > most:
                blocked.add(path)
                continue
            target.append(source[at])
            size += need
        at += 1
    limit = 4096
    while _bytes(noted) > most and limit >= 16:
        noted = _shortened(noted, limit)
        limit //= 2
    return json.dumps(noted, ensure_ascii=False, indent=2)


def _shortened(value: Any, limit: int) -> Any:
    if isinstance(value, str):
        return value if len(value.encode()) <= limit else value.encode()[: limit - 3].decode(errors="ignore") + "..."
    if isinstance(value, list):
        return [_shortened(v, limit) for v in value]
    return {k: _shortened(v, limit) for k, v in value.items()} if isinstance(value, dict) else value


def section(title: str, rows: list[str], limit: int) -> list[str]:
    """A heading and its rows; ``- ...`` where more exist."""
    if not rows:
        return []
    return ["", f"{title}:", *(f"  - {r}" for r in rows[:limit]), *(["  - ..."] if len(rows) > limit else [])]


def tree(names: list[str], depth: int = 3) -> list[str]:
    """Slash-separated names as an indented outline, so many levels deep."""
    out, seen = [], set()
    for name in sorted(names):
        parts = name.split("/")[:depth]
        for k in range(1, len(parts) + 1):
            head = tuple(parts[:k])
            if head not in seen:
                seen.add(head)
                out.append("  " * (k - 1) + parts[k - 1])
    return out


def outline(files: list[str], most: int = 400) -> list[str]:
    """Directories with counts, unfolded from the bottom up while their names stay within ``most`` bytes."""
    below: dict[str, list[str]] = {}
    for f in files:
        folder, _, name = f.rpartition("/")
        below.setdefault(folder, []).append(name)
    out = []
    for folder in sorted(below):
        names = sorted(below[folder])
        listed = ", ".join(names)
        out.append(f"{folder or '.'}/ ({len(names)} files)" if len(listed.encode()) > most else f"{folder or '.'}/ {listed}")
    return out


def document(value: Any, title: str = "", level: int = 1) -> list[str]:
    """An answer as Markdown lines: headings for parts, one line a row, empty parts left out."""
    lines = [f"{'#' * level} {title}"] if title else []
    if isinstance(value, dict) and any(isinstance(v, (dict, list)) for v in value.values()):
        for k, v in value.items():
            if isinstance(v, (dict, list)):
                if v:
                    lines += ["", *document(v, str(k).replace("_", " "), level + bool(title))]
            elif v not in (None, ""):
                lines.append(f"{k}: {v}")
    elif isinstance(value, list):
        lines += [f"- {row_text(v)}" for v in value]
    elif isinstance(value, dict):
        lines += [f"- {k}: {v}" for k, v in value.items()]
    else:
        lines.append(str(value))
    return lines


#: Sections of a summary and of an inspection, in the order that they are shown.
SUMMARY = ("languages", "readme", "packages", "roles", "boundaries", "references", "surfaces", "most_called", "clusters", "unscanned", "unparsed")
INSPECTION = ("candidates", "profile", "variables", "dense_files", "files", "outline", "definitions", "entries", "boundary", "specifiers", "related", "trace", "docstring", "documentation", "snippet")


def sections(answer: dict, title: str, order: tuple[str, ...], limit: int = 20) -> list[str]:
    """An answer's parts in a fixed order, empty ones left out; lists end in ``- ...`` beyond the limit."""
    lines = [f"# {title}"]
    for name in order:
        value, heading = answer.get(name), name.replace("_", " ").capitalize()
        if name == "surfaces" and value:
            lines += ["", f"{heading}:", *(f"  {x}" for x in tree([r["file"] for r in value]))]
        elif isinstance(value, list):
            lines += section(heading, [row_text(v) for v in value], limit)
        elif isinstance(value, dict):
            lines += section(heading, [row_text(value)], limit)
        elif value:
            lines += ["", f"{heading}:", *str(value).split("\n")]
    return lines


#: Headings of the lanes of a search, and what a lane's answer rests on.
LANES = {
    "path": ("Path Matches", ""), "definition": ("Definitions", ""), "member": ("Definitions", "members of the named class"), "coverage": ("Term Coverage", "files that hold the most terms, closest together"),
    "text": ("Text Matches", "exact text, whatever its case"), "concept": ("Paths", "files whose path names every term"), "partial": ("Partial Matches", "no file holds all terms"),
    "graph": ("Graph Matches", ""), "semantic": ("Semantic Matches", "names and documentation by BM25"),
}


def search_lines(found: list[dict], lane: str, limit: int) -> list[str]:
    """A search's answer: the lane's heading and note, rows, and how many candidates are left out."""
    if not found:
        return []
    title, note = LANES[found[0].get("lane", lane)]
    rows = [{k: v for k, v in r.items() if k != "lane"} for r in found]
    more = len(rows) - limit
    return [f"# {title}", *([f"note: {note}"] if note else []), *(f"- {row_text(r)}" for r in rows[:limit]), *([f"... at least {more} more candidate{'s' * (more > 1)}"] if more > 0 else [])]


def row_text(row: Any) -> str:
    """A row on one line: where it is first, then what is known of it."""
    if not isinstance(row, dict):
        return str(row)
    place = row.get("path") or row.get("file") or row.get("file_path") or row.get("id") or ""
    line = row.get("line") or row.get("line_start")
    head = f"{place}:{line}" if place and line else str(place)
    rest = {k: v for k, v in row.items() if k not in ("path", "file", "file_path", "id", "line", "line_start") and v not in (None, "", [])}
    tail = ", ".join(f"{k}={score(v) if isinstance(v, float) else payload.cell(v)}" for k, v in rest.items())
    return f"{head} {tail}".strip()
