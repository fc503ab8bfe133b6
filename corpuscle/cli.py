"""Command line: summary, search, inspect, signals, backend, index."""

from __future__ import annotations

import argparse
import json
import sys
import time

from corpuscle.functions import render


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuscle")
    p.add_argument("--project-root", default=".")
    p.add_argument("--json", action="store_true", help="valid JSON within the output budget instead of text")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("summary")
    s = sub.add_parser("search")
    s.add_argument("words", nargs="+")
    s.add_argument("--graph", action="store_true")
    s.add_argument("--semantic", action="store_true")
    s.add_argument("--limit", type=int, default=15)
    s.add_argument("--include-tests", action="store_true")
    for name in ("label", "name-pattern", "qn-pattern", "file-pattern", "relationship"):
        s.add_argument(f"--{name}")
    for name in ("min-degree", "max-degree", "offset"):
        s.add_argument(f"--{name}", type=int)
    s.add_argument("--exclude-entry-points", action="store_true")
    s.add_argument("--lang")
    s.add_argument("--pattern")
    s.add_argument("--rule")
    i = sub.add_parser("inspect")
    i.add_argument("target")
    i.add_argument("--limit", type=int, default=10)
    g = sub.add_parser("signals")
    g.add_argument("section", nargs="?", default="top")
    g.add_argument("--include-tests", action="store_true")
    b = sub.add_parser("backend")
    b.add_argument("action", choices=("projects", "status", "schema", "query", "changes"))
    b.add_argument("text", nargs="?")
    b.add_argument("--max-rows", type=int, default=200)
    b.add_argument("--hops", type=int, default=2)
    x = sub.add_parser("index")
    for command in (b, x):
        command.add_argument("--catalog", help="folder of saved projects, shared by the cluster")
        command.add_argument("--name", help="the project's name there")
    return p


#: Languages that patterns and rules may name.
LANGUAGES = ("python", "py", "typescript", "ts", "tsx", "javascript", "js", "jsx")


def readable_reason(reason: str) -> str:
    """A failure as one line: the hint of a JSON reason, with its outcome; other reasons as they are."""
    try:
        payload = json.loads(reason)
    except ValueError:
        return reason.strip().split("\n")[0]
    hint, outcome = (str(payload.get(k) or "").strip() for k in ("hint", "outcome")) if isinstance(payload, dict) else ("", "")
    return ": ".join(x for x in (outcome, hint) if x) if hint else reason


def answer(engine, args: argparse.Namespace):
    """The answer of one command; ValueError on bad usage."""
    from corpuscle.sources import catalog

    began = time.perf_counter()
    if args.command == "summary":
        return engine.summary()
    if args.command == "inspect":
        return engine.inspect(args.target, args.limit)
    if args.command == "signals":
        return engine.signals(args.section)
    if args.command == "backend":
        if args.action == "query":
            return engine.query(args.text or "", args.max_rows)
        if args.action in ("projects", "changes"):
            if not args.catalog:
                raise ValueError(f"backend {args.action} needs --catalog")
            if args.action == "projects":
                return [row for page in catalog.pages(catalog.projects(engine.spark, args.catalog), "name") for row in page]
            return engine.changes_since(catalog.state(engine.spark, args.catalog, args.name or "", "digests"), args.hops)
        return engine.schema() | ({"milliseconds": round(1000 * (time.perf_counter() - began))} if args.action == "status" else {})
    if args.command == "index":
        engine.refresh()
        if args.catalog:
            return catalog.save(engine, args.catalog, args.name or "corpus", args.project_root)
        return engine.schema()
    if args.graph and args.semantic:
        raise ValueError("choose one lane")
    filters = {k: v for k in ("label", "name_pattern", "qn_pattern", "file_pattern", "relationship", "min_degree", "max_degree", "offset") if (v := getattr(args, k)) is not None}
    if args.exclude_entry_points:
        filters["exclude_entry_points"] = True
    if filters and not args.graph:
        raise ValueError("graph filters need --graph")
    first, rest = args.words[0], args.words[1:]
    if first == "calls" and rest:
        return engine.calls(rest[0], args.limit if args.limit != 15 else 1000)
    structural = None
    if first == "match" and args.pattern:
        if args.lang and args.lang.lower() not in LANGUAGES:
            raise NotImplementedError(f"no scanner for {args.lang}")
        structural = engine.match(args.pattern, args.lang)
    if first == "rule" and args.rule:
        try:
            with open(args.rule) as f:
                text = f.read()
        except OSError as error:
            raise ValueError(f"rule file: {error.strerror}") from error
        structural = engine.rule(text)
    if structural is not None:
        from corpuscle.operators.match import match_json

        return {"total": len(structural), "matches": [match_json(r) for r in structural]} if args.json and structural else structural
    lane = "graph" if args.graph else "semantic" if args.semantic else "source"
    found = engine.search(" ".join(args.words), lane, args.limit + 1, **filters)
    if args.json:
        return found[: args.limit]
    return render.search_lines(found, lane, args.limit)


def main(argv: list[str] | None = None) -> int:
    """0: an answer, 1: none or an error, 2: bad usage, 127: a language without a scanner."""
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from corpuscle.engine import Engine

    spark = SparkSession.builder.appName("corpuscle").getOrCreate()
    with Engine.open(spark, args.project_root, include_tests=getattr(args, "include_tests", False)) as engine:
        try:
            out = answer(engine, args)
        except ValueError as error:
            print(error, file=sys.stderr)
            return 2
        except NotImplementedError as error:
            print(error, file=sys.stderr)
            return 127
        except Exception as error:  # of Spark, mostly: one line, no trace
            print(readable_reason(str(error)), file=sys.stderr)
            return 1
    plain = json.loads(json.dumps(out, default=str))
    if args.command == "search" and plain and isinstance(plain, list) and isinstance(plain[0], str):
        lines = plain
    elif args.command == "summary":
        lines = render.sections(plain, "Summary", render.SUMMARY)
    elif args.command == "inspect":
        lines = render.sections(plain, str(plain["target"]), render.INSPECTION, args.limit)
    else:
        lines = render.document(plain, args.command)
    print(render.json_within(plain) if args.json else render.text_within("\n".join(lines)))
    return 0 if out else 1


if __name__ == "__main__":
    sys.exit(main())
