"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Sources share a budget of words by weight; a target stops at ``most`` times its source's
size, and what it leaves goes to the others by weight. All sources under the stop have
one level, target = level * weight, so each round of resharing is one aggregate over the
sources: those above the stop at this level give their stops, the rest a new level.

A source first repeats in whole epochs. What is left of its target is drawn: each document
has an exponential key, its rate the document's quality weight, and documents enter in the
order of their keys until the budget is used; the last one enters with as many of its words
as the budget still has, so a source takes its target rounded down. Keys come from the id, so that
reruns agree. Documents are sorted by (source, key) in ranges: sums of ranges tell which are
in, which out, and which single range of a source holds its end; only rows of these ranges are
summed one by one. No task holds a source.

Defined cases: a null text has size 0, and documents of size 0 take nothing; a null source
is a source of its own, the last; a null id takes part as an empty one; rows that repeat an id
are documents each, with the id's draw, ordered by a hash of id and text; equal rows are taken
one by one, in any order; sources without words have target 0; weights that are null,
not finite or not above 0 count as 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.cut import Scratch, cut, within
from corpuscle.llm.order import placed, ranked
from corpuscle.llm.rows import row_hash

# The sources' weights in turn, the budget in percent of all words, and the most epochs.
WEIGHTS, PERCENT, MOST = (5, 2, 1), 150, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Quality weights of documents with a good, a bad, and no label.
GOOD, BAD, UNKNOWN = 4.0, 1.0, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): quality weights of labelled documents; the better label counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    return known.select("doc_id", F.when(F.col("good") > 0, GOOD).otherwise(BAD).alias("weight"))


def draw_key(doc_id: Column, weight: Column) -> Column:
    """An exponential number of rate ``weight``, drawn from the id; the smallest keys are drawn first."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 12), 16, 10).cast("double")
    return -F.log((h + 0.5) / float(2**48)) / weight


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """``sources`` (source, source_size), a written table, with number in code point order, weight and target."""
    numbered = ranked(sources, [F.col("source").isNull().asc(), F.asc("source")], scratch, "number")
    each = F.array(*(F.lit(float(w)) for w in weights))
    weighed = scratch.table(numbered.withColumn("weight", F.get(each, F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int"))))
    stop = F.col("source_size") * most
    budget = percent * (weighed.agg(F.sum("source_size")).first()[0] or 0) / 100
    level, stopped = 0.0, -1
    while True:
        above = F.lit(stopped >= 0) & (F.lit(level) * F.col("weight") > stop)
        r = weighed.agg(F.sum(F.when(above, stop).otherwise(0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if r.n == stopped or not r.open:
            level = level if r.open else float("inf")
            break
        stopped, level = r.n, max(0.0, budget - r.full) / r.open
    return weighed.withColumn("target", F.when(F.lit(level) * F.col("weight") > stop, stop.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def mix(documents: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(doc_id, row, source, size, source_size, target, taken) of every document; ``row`` is of ``row_hash``.

    ``quality``: (doc_id, weight), one row an id; documents it lacks have weight ``UNKNOWN``.
    ``taken`` counts a document's words in the mix, repeats included.
    """
    with Scratch(documents.sparkSession) as scratch:
        rows = documents.select("doc_id", row_hash().alias("row"), "source", word_count(F.col("text")).alias("size"))
        if quality is None:
            rows = rows.withColumn("weight", F.lit(1.0))
        else:
            rows = rows.join(quality.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(UNKNOWN)))
        sound = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
        rows = scratch.table(rows.select("doc_id", "row", "source", "size", draw_key(F.col("doc_id"), F.when(sound, F.col("weight")).otherwise(1.0)).alias("key")))
        sizes = scratch.table(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
        whole = F.floor("target").cast("long")
        epochs = F.when(F.col("source_size") > 0, F.expr("CAST(FLOOR(target) AS BIGINT) DIV source_size")).otherwise(0)
        plan = targets(sizes, weights, percent, most, scratch).withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
        plan = scratch.table(plan.select(F.col("source").alias("_source"), "number", "source_size", "target", "epochs", "rest"))
        rows = rows.join(within(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        ordered = placed(scratch.table(rows), [F.asc("number"), F.asc("key"), F.asc_nulls_last("doc_id"), F.asc("row")], scratch)
        earlier = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        sums = ordered.groupBy("number", "part").agg(F.sum("size").alias("sum"))
        sums = scratch.table(sums.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).withColumnRenamed("number", "_number").withColumnRenamed("part", "_part"))
        found = ordered.join(within(sums), (F.col("number") == F.col("_number")) & (F.col("part") == F.col("_part")))
        ends = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("sum"))
        columns = ["doc_id", "row", "source", "size", "source_size", "target"]
        taken = F.col("epochs") * F.col("size")
        clear = found.where(~ends).select(*columns, (taken + F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(0)).alias("taken"))
        inside = Window.partitionBy("number").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # one range of a source
        left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
        last = found.where(ends).withColumn("left", left).select(*columns, (taken + F.greatest(F.lit(0), F.least("size", "left"))).alias("taken"))
        return cut(clear.unionByName(last))


def mixed_texts(documents: DataFrame, mixture: DataFrame) -> DataFrame:
    """The mix itself: ``documents`` once for each time a document is in, with ``epoch`` from 1.

    A document that enters in part has the words that the budget had for it, parted by one
    space. Rows that repeat id and text count as one document, which is in as often as all of them.
    """
    key = ["_id", "_row"]
    texts = documents.select(F.struct("*").alias("_d"), F.col("doc_id").alias("_id"), row_hash().alias("_row")).dropDuplicates(key)
    taken = mixture.groupBy(F.col("doc_id").alias("_id2"), F.col("row").alias("_row2")).agg(F.first("size").alias("_size"), F.sum("taken").alias("_taken")).where("_taken > 0")
    both = texts.join(taken, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")))
    rows = both.select("_d", "_size", "_taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))).alias("_epoch"))
    words = F.col("_taken") - (F.col("_epoch") - 1) * F.col("_size")
    part = F.array_join(F.slice(F.regexp_extract_all("_d.text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("_size"), part).otherwise(F.col("_d.text"))
    return rows.select(*((text if c == "text" else F.col("_d")[c]).alias(c) for c in documents.columns if c != "epoch"), F.col("_epoch").alias("epoch"))
