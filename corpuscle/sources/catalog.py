"""Saved states of corpora in a shared folder: fact tables as Parquet, one row each in a listing."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = 500
PROJECTS = "name string, root string, status string, files long, nodes long, edges long, saved timestamp"
TABLES = ("inventory", "facts", "docs", "nodes", "edges", "digests")


def _name(name: str) -> str:
    if not re.fullmatch(r"[\w.-]+", name):
        raise ValueError("a project's name has letters, digits, dots, hyphens and underscores")
    return name


def save(engine, folder: str, name: str, root: str = "") -> dict:
    """Write a corpus's tables below ``folder``/``name``, in place of an earlier state; the project's row.

    Partial states are never listed: the row is written last.
    """
    spark, base = engine.spark, f"{folder.rstrip('/')}/{_name(name)}"
    states = {"inventory": engine.inventory, "facts": engine.facts, "docs": engine.docs, "nodes": engine.nodes, "edges": engine.edges, "digests": engine.files.select(F.col("path").alias("node"), F.xxhash64("text").alias("digest"))}
    for table in TABLES:
        states[table].write.mode("overwrite").parquet(f"{base}/{table}")
    counts = {t: spark.read.parquet(f"{base}/{t}").count() for t in ("inventory", "nodes", "edges")}
    row = spark.createDataFrame([(name, root, "ready", counts["inventory"], counts["nodes"], counts["edges"])], PROJECTS.rsplit(",", 1)[0]).withColumn("saved", F.current_timestamp())
    row.write.mode("overwrite").parquet(f"{base}/project")
    return row.drop("saved").first().asDict()


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """(name, root, status, files, nodes, edges, saved) of the saved projects; none in an empty folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/project")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ()
    if not len(found):
        return spark.createDataFrame([], PROJECTS)
    return spark.read.schema(PROJECTS).parquet(*(s.getPath().toString() for s in found))


def pages(rows: DataFrame, order: str, size: int = PAGE) -> Iterator[list[dict]]:
    """Rows in order of a unique column, a page at a time, each read beginning behind the last."""
    after = None
    while True:
        page = (rows if after is None else rows.where(F.col(order) > after)).orderBy(order).limit(size).collect()
        if page:
            yield [r.asDict() for r in page]
            after = page[-1][order]
        if len(page) < size:
            return


def state(spark: SparkSession, folder: str, name: str, table: str) -> DataFrame:
    """A table of a saved project."""
    if table not in TABLES:
        raise ValueError(f"table must be one of {', '.join(TABLES)}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{_name(name)}/{table}")
