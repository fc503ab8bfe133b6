"""Components of what is similar within buckets of candidates: no similar pair is left apart, and none within a component is compared.

Rows that meet in a bucket (or by a value) are parted by component: those outside its largest
component meet all others, so that a join makes at most as many rows as there are ordered pairs
of different components, however large one component is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.components import components, extended, labelled
from corpuscle.llm.cut import Scratch, within


#: Times that the members of large buckets meet a typical one.
STARS = 3


def close_buckets(members: DataFrame, links: DataFrame, percent: int, few: int, confirmed: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(node, component), as ``components`` gives them, of ``links`` and whatever else joins all similar sets of a bucket.

    ``members``: key, node. ``confirmed`` keeps those of pairs (a, b), a > b, whose sets have a
    Jaccard similarity of ``percent`` or more; ``sets_of`` gives (node, grams) for nodes.

    A bucket in one component is done. One with at most ``few`` ordered pairs of different
    components for each member has these pairs compared. In others, all members first meet the
    most typical one (that lies in most such buckets), then the most typical one of those outside the
    largest component, ``STARS`` times in all; this joins copies with few changes. If
    still too many pairs are left, members meet by ``links_by_prefix``.
    """
    labels = components(links, scratch)

    def state(rows: DataFrame) -> DataFrame:
        """``rows`` of the buckets that still hold several components; those in one are done for good."""
        named = scratch.table(labelled(rows.select("key", "node"), labels))
        sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
        squares = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs")
        keys = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("members"), squares, F.max_by("component", F.struct("n", "component")).alias("largest"))
        open_ = scratch.table(keys.where("parts > 1").select("key", (F.col("pairs") > few * F.col("members")).alias("wide"), "largest"))
        return scratch.table(named.join(open_, "key").select("key", "node", "component", "wide", (F.col("component") == F.col("largest")).alias("main")))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()

    rows = state(members)
    for star in range(STARS):
        wide = rows.where("wide")
        if wide.isEmpty():
            break
        held = wide.groupBy("node").agg(F.count("*").alias("keys"))
        able = wide.where("NOT main") if star else wide
        typical = able.join(held, "node").groupBy("key").agg(F.max(F.struct("keys", "node"))["node"].alias("b"), F.max_by("component", F.struct("keys", "node")).alias("other"))
        found = confirmed(ordered(wide.join(typical, "key").where("component <> other")))
        if found.isEmpty():
            break
        labels = extended(labels, found, scratch)
        rows = state(rows)
    both = rows.where("NOT wide").select("key", "node", "component", "main")
    others = both.select("key", F.col("node").alias("b"), F.col("component").alias("other"), F.col("main").alias("_main"))
    labels = extended(labels, confirmed(ordered(both.where("NOT main").join(others, "key").where("component <> other AND (_main OR node > b)"))), scratch)
    wide = rows.where("wide").select("key", "node")
    if wide.isEmpty():
        return labels
    return links_by_prefix(wide, scratch.table(sets_of(wide.select("node").distinct())), links, percent, confirmed, scratch, labels)


def links_by_prefix(buckets: DataFrame, sets: DataFrame, links: DataFrame, percent: int, confirmed: Callable[[DataFrame], DataFrame], scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """(node, component), as ``components`` gives them, of ``links`` and whatever joins all similar sets of ``buckets``.

    ``buckets``: key, node. ``sets``: node, grams (distinct longs) of each node there.
    ``confirmed`` keeps those of pairs (a, b), a > b, whose sets have a Jaccard similarity
    of ``percent`` or more. ``labels``, if there are any, are ``components`` of the links, and of more.

    Values are ordered by how many of these sets hold them, rarest first. Of two similar
    sets, the smaller one's first 1 - 2p/(1+p) and the larger one's first 1 - p have a value
    in common, and the first such value leaves enough places after it on both sides. A
    part that a third of the sets share comes last, so sets with enough of their own never
    meet by it; values that no other set has, or only sets of one component, are not listed.
    First, each bucket's sets meet its most typical one (of the most common values), which joins
    the copies with few changes; sets whose buckets are one component by then take no further part.
    """
    labels = components(links, scratch) if labels is None else labels
    grams = labelled(sets, labels).select("node", F.xxhash64("component").alias("part"), F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("sets"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").drop("low", "high")
    shared = grams.join(common, "gram").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("shared"), F.sum("sets").alias("held"))
    n, p = F.col("n"), F.lit(percent)
    own = n - F.size("shared")  # values of one component only come first, as the rarest do: nothing has to meet by them
    first = F.slice("shared", F.lit(1), F.greatest(F.lit(0), n - F.ceil(n * p / 100) + 1 - own).cast("int"))
    placed_first = F.transform(first, lambda x, i: F.struct((own + i).alias("at"), x["gram"].alias("gram")))
    ordered = scratch.table(shared.select("node", "n", ((F.col("held") + own) / n).alias("typical"), placed_first.alias("first")))
    typical = buckets.join(ordered.select("node", "typical"), "node").groupBy("key").agg(F.max(F.struct("typical", "node"))["node"].alias("b"))
    stars = buckets.join(typical, "key").where("node <> b").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    found = confirmed(stars)
    labels = extended(labels, found, scratch)
    mixed = labelled(buckets, labels).groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    still = scratch.table(buckets.join(mixed.select("key"), "key", "left_semi").select("node").distinct())
    placed = labelled(ordered.join(within(still), "node", "left_semi"), labels)
    placed = scratch.table(placed.select("node", "n", "component", F.explode("first").alias("x")).select("node", "n", "component", "x.at", "x.gram"))
    parts = placed.groupBy("gram", "component").agg(F.count("*").alias("sets")).groupBy("gram")
    tops = scratch.table(parts.agg(F.max_by("component", F.struct("sets", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    placed = scratch.table(placed.join(tops, "gram").withColumn("main", F.col("component") == F.col("largest")).drop("largest"))
    larger = placed.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("atb"), F.col("component").alias("other"), F.col("main").alias("_main"))
    smaller = placed.where(f"{100 + percent} * at <= {100 - percent} * n")
    left = f"{100 + percent} * LEAST(n - at, nb - atb) >= {percent} * (n + nb)"
    open_ = f"component <> other AND (n < nb OR n = nb AND node < b) AND 100 * n >= {percent} * nb AND {left}"
    met = smaller.where("NOT main").join(larger, "gram").where(open_).unionByName(smaller.where("main").join(larger.where("NOT _main"), "gram").where(open_))
    return extended(labels, confirmed(met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()), scratch)
