"""A corpus's facts and import graph as versions in a folder; a refresh parses changed files only.

A version holds ``files`` (path, digest), ``facts`` and ``imports`` (source, target). A refresh
scans the files whose digest is new, and resolves again the imports of these files and of
importers that a file which came or went can concern; all else is carried over. ``versions``
gets a row last, so that a refresh which fails leaves the version before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import fixed, paths
from corpuscle.operators import facts, imports

_CONFIG = r"(^|/)(tsconfig|jsconfig)[^/]*\.json$|\.json$"


@dataclass
class Refreshed:
    """What a refresh did: its version, files scanned, gone, and files whose imports were resolved again."""

    version: int
    parsed: int
    removed: int
    resolved: int


def _name(path: Column) -> Column:
    """The name by which imports speak of a file: its stem, or its folder's if it is an index."""
    stem = F.regexp_extract(paths.basename(path), r"^([^.]*)", 1)
    return F.lower(F.when(stem.isin("__init__", "index"), paths.basename(paths.dirname(path))).otherwise(stem))


def _names_meant() -> Column:
    """Last parts of what an import fact may mean, lower case; an empty one is the file's own folder."""
    last = lambda c, sign: F.substring_index(c, sign, -1)
    stem = F.regexp_extract(last(F.col("identifier"), "/"), r"^([^.]*)", 1)
    return F.transform(F.array(F.col("name"), last(F.col("name"), "."), last(F.col("identifier"), "."), stem), lambda x: F.lower(x))


class Snapshot:
    """Versions of one corpus in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, version: int, name: str) -> str:
        return f"{self.folder}/{name}/v={version}"

    def version(self) -> int | None:
        """The newest whole version."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("version int").parquet(f"{self.folder}/versions").agg(F.max("version")).first()[0]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """``files``, ``facts`` or ``imports`` of a version, else of the newest."""
        return self.spark.read.parquet(self._path(self.version() if version is None else version, name))

    def _write(self, version: int, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(version, name))
        return self.spark.read.parquet(self._path(version, name))

    def _resolved(self, rows: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
        return imports.import_map(rows, files.select("path"), None if configs.isEmpty() else configs)

    def refresh(self, corpus: DataFrame) -> Refreshed:
        """Bring the snapshot to ``corpus`` (path, text); the first time all files are scanned."""
        before = self.version()
        new = 0 if before is None else before + 1
        inventory = self._write(new, "files", corpus.select("path", F.xxhash64("text").alias("digest")))
        configs = corpus.where(F.col("path").rlike(_CONFIG))
        if before is None:
            found = self._write(new, "facts", facts.facts(corpus))
            self._write(new, "imports", self._resolved(found, inventory, configs))
            parsed = resolved = inventory.count()
            gone = 0
        else:
            old = self.table("files", before).withColumnRenamed("digest", "_old")
            both = inventory.join(old, "path", "full")
            state = F.when(F.col("_old").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("_old"), "changed")
            moves = self._write(new, "moves", both.select("path", state.alias("state")).where("state IS NOT NULL"))
            here = moves.where("state <> 'removed'").select("path")
            kept_facts = self.table("facts", before).join(moves.select("path"), "path", "left_anti")
            scanned = self._write(new, "scanned", facts.facts(corpus.join(here, "path", "left_semi")))
            rows = self._write(new, "facts", kept_facts.unionByName(scanned))
            again = self._write(new, "again", self._concerned(rows, moves).unionByName(here).distinct())
            resolved_rows = self._resolved(rows.join(again, "path", "left_semi"), inventory, configs)
            touched = again.unionByName(moves.select("path")).distinct().withColumnRenamed("path", "source")
            carried = self.table("imports", before).join(touched, "source", "left_anti")
            self._write(new, "imports", carried.unionByName(resolved_rows))
            parsed, gone, resolved = here.count(), moves.where("state = 'removed'").count(), again.count()
        self.spark.createDataFrame([(new,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        return Refreshed(new, parsed, gone, resolved)

    def _concerned(self, rows: DataFrame, moves: DataFrame) -> DataFrame:
        """(path): importers that may mean a file that came or went. A package's beginning concerns all Python importers, a config all scripts."""
        importing = rows.where("kind IN ('import', 'from', 'reexport')")
        came = moves.where("state <> 'changed'")
        named = came.select(_name(F.col("path")).alias("meant")).distinct()
        own = F.array_distinct(F.concat(_names_meant(), F.split(F.lower(paths.dirname(F.col("path"))), "/")))  # folders around the importer, for what `..` means
        out = importing.select("path", F.explode(own).alias("meant")).join(named, "meant", "left_semi").select("path")
        flags = moves.agg(
            F.coalesce(F.bool_or((paths.basename(F.col("path")) == "__init__.py") & (F.col("state") != "changed")), F.lit(False)).alias("packages"),
            F.coalesce(F.bool_or(F.col("path").rlike(_CONFIG)), F.lit(False)).alias("configs"),
        ).first()
        suffix = F.lower(paths.suffix(F.col("path")))
        if flags.packages:
            out = out.unionByName(importing.where(suffix.isin(*fixed.PYTHON_SUFFIXES)).select("path"))
        if flags.configs:
            out = out.unionByName(importing.where(suffix.isin(*fixed.SCRIPT_SUFFIXES)).select("path"))
        return out.distinct()
