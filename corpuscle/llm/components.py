"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.cut import Scratch, cut

#: Links up to which what a join looks up is broadcast: a round of a small graph shuffles for groups only.
FEW_LINKS = 25_000
#: Rows of links or labels in one part of what a round writes; small graphs are not dealt over as many files as there are shuffle partitions.
PART = 100_000


def together(df: DataFrame, rows: int) -> DataFrame:
    """``df``, if its rows are few, as one part, so that what follows is one task."""
    return df.coalesce(1) if rows <= FEW_LINKS else df


def written(df: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """``df`` as a scratch table. A checkpoint would keep the planner's size estimate, the product of all joined sizes
    so far; from round to round that number's digits multiply, up to hundreds of MB on the driver."""
    return scratch.table(df.coalesce(1 + rows // PART))


def moved(df: DataFrame, column: str, to: DataFrame, few: bool) -> DataFrame:
    """``df`` with the component of ``column`` there, where ``to`` names one; ``few``: ``to`` is broadcast."""
    named = to.select(F.col("node").alias(column), F.col("component").alias("_to"))
    return df.join(F.broadcast(named) if few else named, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of each node that has a larger id than its component.

    ``links`` has columns a and b of one type that has an order. A component is named by its smallest node; that node
    itself, and nodes without links, have no row. Each round hooks every node to its
    smallest smaller neighbour, shortens the paths by pointer jumping and contracts the
    links, so rounds grow with the logarithm of a component's extent. Nothing is
    collected; each round is written to ``scratch``, where the result stays (without one: a checkpoint). Up to FEW_LINKS links, what a round looks up is broadcast and
    the rest is one part, so that small graphs take few jobs; larger ones are dealt out by shuffles.
    """
    if scratch is None:
        with Scratch(links.sparkSession) as own:
            return cut(components(links, own))
    n = links.count()
    few = n <= FEW_LINKS

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def part(df: DataFrame) -> DataFrame:
        return together(df, n)

    edges = written(oriented(part(links)), n, scratch)
    labels, named = None, 0
    while n_edges := part(edges).count():
        hooks = written(part(edges).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), n_edges, scratch)
        while True:
            twice = moved(part(hooks), "component", part(hooks), few)
            hooks = written(moved(twice, "component", twice, few), n_edges, scratch)  # four steps at once: most graphs need one such round
            further = moved(part(hooks).select(F.col("component").alias("end"), "component"), "component", part(hooks), few)
            if further.where("end <> component").isEmpty():
                break
        named += n_edges
        labels = hooks if labels is None else written(moved(part(labels), "component", part(hooks), few).unionByName(hooks), named, scratch)
        edges = written(oriented(moved(moved(part(edges), "a", part(hooks), few), "b", part(hooks), few)), n_edges, scratch)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", "component")


def extended(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels``, as ``components`` gives them, after more ``links``; only the links between components are worked on."""
    n = links.count()
    if not n:
        return labels
    total = n + labels.count()
    few = total <= FEW_LINKS
    links, labels = together(links, total), together(labels, total)
    named = moved(moved(links.select("a", "b"), "a", labels, few), "b", labels, few)
    more = components(written(named.where("a <> b"), n, scratch), scratch)
    return written(moved(labels.select("node", "component"), "component", together(more, total), few).select("node", "component").unionByName(more), total, scratch)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (with a column node) and their component, which without a label is the node itself."""
    return rows.join(labels.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
