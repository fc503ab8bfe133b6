"""Files as rows: discovery in a folder or a store, ignore rules, inventory, manifests, READMEs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import paths
from corpuscle.operators.search import line_count


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """(pattern of paths, whether it brings back) of a line of an ignore file; None of comments.

    ``!`` brings back, a leading slash anchors, no slash means any level, ``*`` crosses slashes.
    """
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    again, rule = rule.startswith("!"), rule.lstrip("!").rstrip("/")
    anchored = "/" in rule
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", rule.lstrip("/")))
    return f"^{'' if anchored else '(.*/)?'}{body}(/.*)?$", again


def is_ignored_by(path: Column, rules: list[str]) -> Column:
    """Whether the last of the rules that match a path ignores it."""
    out = F.lit(False)
    for rule in rules:
        parsed = ignore_pattern(rule)
        if parsed:
            out = F.when(path.rlike(parsed[0]), not parsed[1]).otherwise(out)
    return out


def ignore_rules(ignores: DataFrame) -> DataFrame:
    """(directory, depth, no, pattern, again) of each line of ignore files (path, text), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                directory = path.rpartition("/")[0]
                parsed = [ignore_pattern(line) for line in (text or "").splitlines()]
                rows += [(directory, directory.count("/") + bool(directory), no, *rule) for no, rule in enumerate(parsed) if rule]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()))], ["directory", "depth", "no", "pattern", "again"])

    return ignores.select("path", "text").mapInArrow(run, "directory string, depth int, no int, pattern string, again boolean")


def ignore_files(spark: SparkSession, root, depth: int) -> list[tuple[str, str]]:
    """(path, text) of the ignore files down to a depth; Spark's readers pass over hidden files, so the store is asked."""
    fs, out = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    base = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    for level in range(depth + 1):
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "*/" * level + ".gitignore")) or ():
            stream = fs.open(status.getPath())
            try:
                out.append((status.getPath().toUri().getPath()[len(base) :], spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return out


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths that ignore files above them ignore: the last matching line of the deepest file decides.

    Files meet the rules of the directories above them by equality.
    """
    above = files.select("path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), paths.ancestors(F.col("path"))))).alias("directory"))
    inner = F.when(F.col("directory") == "", F.col("path")).otherwise(F.expr("substring(path, length(directory) + 2)"))
    hits = above.join(rules, "directory").where(F.regexp(inner, F.col("pattern")))
    last = hits.groupBy("path").agg(F.max_by("again", F.struct("depth", "no")).alias("again"))
    return last.where("NOT again").select("path")


def read_files(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """(path, text) of the files below ``root`` that discovery takes; ``root`` may be of any store.

    The reader lists and reads in parallel; path policy drops rows before their bytes decode.
    Ignore files of all levels are read where no rules are given.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toUri().getPath().rstrip("/") + "/"
    here = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    rows = raw.select(F.substring(here, len(base) + 1, 2**31 - 1).alias("path"), "content")
    scanned = rows.where(paths.is_scanned(F.col("path")))
    if rules is None:
        depth = scanned.agg(F.max(F.size(paths.ancestors(F.col("path"))))).first()[0] or 0
        ignores = spark.createDataFrame(ignore_files(spark, jvm_path, depth), "path string, text string")
        taken = scanned.join(ignored_paths(scanned.select("path"), ignore_rules(ignores)), "path", "left_anti")
    else:
        taken = scanned.where(~is_ignored_by(F.col("path"), rules))
    return taken.select("path", F.decode("content", "UTF-8").alias("text"))


def inventory(files: DataFrame) -> DataFrame:
    """(path, language, category, n_lines, n_bytes) of each file."""
    p = F.col("path")
    return files.select("path", paths.language(p).alias("language"), paths.category(p).alias("category"), line_count(F.col("text")).alias("n_lines"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def targets(files: DataFrame, wanted: list[str]) -> DataFrame:
    """Files that are, or lie in, any of the wanted paths; all without any. A path outside the root is an error."""
    if any(w.startswith("/") or ".." in w.split("/") for w in wanted):
        raise ValueError("a path lies outside the project root")
    out = F.lit(not wanted)
    for w in wanted:
        out = out | paths.within(F.col("path"), F.lit("" if w in (".", "") else w.rstrip("/")))
    return files.where(out)


def manifest(path: str, text: str) -> dict | None:
    """Name, description, dependencies and entry points of a package.json or pyproject.toml."""
    if path.endswith("package.json"):
        try:
            d = json.loads(text)
        except ValueError:
            return None
        entries = [v for v in [d.get("main"), d.get("module"), *(d["bin"].values() if isinstance(d.get("bin"), dict) else [d.get("bin")])] if isinstance(v, str)]
        return {"name": d.get("name") or "", "description": d.get("description") or "", "dependencies": sorted({*d.get("dependencies", {}), *d.get("peerDependencies", {})}), "entries": entries}
    section = re.search(r"^\[project\]\s*$([\s\S]*?)(?=^\[|\Z)", text, re.M)
    if not section:
        return None
    value = lambda key: (re.search(rf'^{key}\s*=\s*"([^"]*)"', section[1], re.M) or ["", ""])[1]
    listed = re.search(r"^dependencies\s*=\s*\[([\s\S]*?)\]", section[1], re.M)
    names = [re.match(r"[A-Za-z0-9_.-]+", d)[0] for d in re.findall(r'"([A-Za-z0-9][^"]*)"', listed[1])] if listed else []
    return {"name": value("name"), "description": value("description"), "dependencies": sorted({n.lower().replace("_", "-") for n in names}), "entries": []}


def packages(files: DataFrame) -> DataFrame:
    """(root, name, description, dependencies, entries) of each folder with a manifest; a folder's manifests merge."""
    some = files.where(paths.basename(F.col("path")).isin("package.json", "pyproject.toml")).where(~F.exists(F.split("path", "/"), lambda x: x.isin("examples", "example", "docs", "tests", "test", "scripts", "fixtures")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [(root, path, manifest(path, text or "")) for root, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            read = [r for r in read if r[2]]
            kind = pa.struct([("name", pa.string()), ("description", pa.string()), ("dependencies", pa.list_(pa.string())), ("entries", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in read], t) for i, t in enumerate((pa.string(), pa.string(), kind))], ["root", "path", "m"])

    rows = some.select(paths.dirname(F.col("path")).alias("root"), "path", "text").mapInArrow(run, "root string, path string, m struct<name: string, description: string, dependencies: array<string>, entries: array<string>>")
    return rows.groupBy("root").agg(F.min_by("m.name", "path").alias("name"), F.min_by("m.description", "path").alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.dependencies")))).alias("dependencies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.entries")))).alias("entries"))


_SKIPPED = re.compile(r"\b(install|installation|setup|getting started|license|contributing|contributors|changelog|badges?|acknowledg|sponsor|code of conduct|development|requirements)\b", re.I)


def readme_outline(text: str) -> list[tuple[int, str, str | None]]:
    """(level, heading, content) of a README, three levels deep; content of the first two prose sections.

    Fenced code, badges, comments and HTML tags go; a setup or licence heading drops all below it.
    """
    out, prose, skip, fenced, kept = [], 0, 0, False, []
    text = re.sub(r"<!--[\s\S]*?-->", "", text)

    def flush() -> None:
        nonlocal prose
        body = " ".join(" ".join(kept).split())
        kept.clear()
        if body and out and out[-1][2] is None and prose < 2 and not skip:
            out[-1] = (out[-1][0], out[-1][1], body)
            prose += 1

    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            continue
        heading = None if fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line) or re.match(r"\s*<h([1-6])[^>]*>(.*?)</h\1>", line, re.I)
        if heading:
            flush()
            level = len(heading[1]) if heading[1].startswith("#") else int(heading[1])
            title = re.sub(r"<[^>]+>|!\[[^\]]*\]\([^)]*\)|[`*_]", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", heading[2])).strip()
            if skip and level > skip:
                continue
            skip = level if _SKIPPED.search(title) else 0
            if not skip and level <= 3 and title:
                out.append((level, title, None))
        elif not fenced and not re.match(r"\s*(\[?!\[|\||[-*_]{3,}\s*$)", line):
            plain = re.sub(r"<[^>]+>", "", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", line))
            kept.append(re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", plain).strip())
    flush()
    return out


def _block(lines: list[tuple[int, str]], indent: int) -> dict | list | str:
    """The value that begins at ``lines[0]``: a mapping, a list or a scalar; what is read goes."""
    if lines[0][1].startswith("- "):
        out: list = []
        while lines and lines[0][0] == indent and lines[0][1].startswith("- "):
            depth, line = lines.pop(0)
            lines.insert(0, (depth + 2, line[2:].lstrip()))
            out.append(_block(lines, depth + 2))
        return out
    found: dict = {}
    while lines and lines[0][0] == indent:
        m = re.match(r"([\w$-]+):(?:\s+(.*?))?\s*$", lines[0][1])
        if not m:
            return lines.pop(0)[1].strip("'\"")
        depth, _ = lines.pop(0)
        if m[2]:
            found[m[1]] = m[2].strip("'\"")
        elif lines and (lines[0][0] > depth or lines[0][0] == depth and lines[0][1].startswith("- ")):
            found[m[1]] = _block(lines, lines[0][0])
        else:
            found[m[1]] = {}
    return found


def rule_file(text: str) -> dict:
    """A syntax rule of JSON or of YAML's mappings, lists and plain scalars; it needs ``language`` and ``rule``."""
    try:
        data = json.loads(text)
    except ValueError:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith(("#", "---"))]
        data = _block(lines, lines[0][0]) if lines else {}
    if not isinstance(data, dict) or not isinstance(data.get("rule"), dict) or not isinstance(data.get("language"), str):
        raise ValueError("a rule needs a language and a rule mapping")
    return data
