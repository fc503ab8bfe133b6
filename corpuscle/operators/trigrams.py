"""An inverted index of trigrams, by which text and pattern scans read candidate files only.

The index is a folder of three tables. ``texts`` holds the files in ``block`` partitions,
by a hash of the path; ``postings`` holds (gram, path, block) in ``shard`` partitions by a hash of the
gram, sorted by it, so that a lookup reads the shards and row groups of its grams;
``grams`` holds each gram's number of files. Grams are three code points of the lower-cased
text, so the index serves scans of either case.

A query is a formula of grams that each matching text holds: for a literal all its
trigrams, for a regular expression what its parse tree makes certain (runs of literals
joined over concatenation, alternatives as any of several, small sets of characters
spelled out; what may be absent or is a class says nothing). The ``RAREST`` grams of each
alternative are looked up, the files that hold all of one alternative's are candidates, and the
scan itself decides on their texts. A query without certain grams is a scan of all files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grams of an alternative that are looked up, the rarest of it.
RAREST = 4
#: Alternatives of a query, and spelled-out strings of a part of it, beyond which less is asked.
ALTERNATIVES, SPELLED = 64, 16
BLOCKS, SHARDS = 64, 32
#: Pieces into which the postings of a shard are dealt, so that common grams fall to several tasks.
SPREAD = 8

Needs = frozenset[frozenset[str]]  # alternatives, each of grams that all have to be there
ANYTHING: Needs = frozenset([frozenset()])


def grams(value: Column) -> Column:
    """The distinct trigrams of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"(?s)(?=(...))"), F.lit(1)))


def _of(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _both(a: Needs, b: Needs) -> Needs:
    """What holds where both do; if that has too many alternatives, the part with fewer."""
    if len(a) * len(b) > ALTERNATIVES:
        return min(a, b, key=len)
    return _least(x | y for x, y in product(a, b))


def _least(needs: Iterable[frozenset[str]]) -> Needs:
    """Alternatives without those that ask for more than another."""
    own = set(needs)
    return frozenset(x for x in own if not any(y < x for y in own))


class _Part:
    """What a part of a pattern makes certain: all its strings if few, else how they begin and end; and grams met."""

    def __init__(self, whole: frozenset[str] | None, head: frozenset[str], tail: frozenset[str], needs: Needs = ANYTHING):
        self.whole, self.head, self.tail, self.needs = whole, head, tail, needs

    @staticmethod
    def of(strings: Iterable[str]) -> _Part:
        own = frozenset(strings)
        return _Part(own, own, own)

    @staticmethod
    def unknown(needs: Needs = ANYTHING) -> _Part:
        return _Part(None, frozenset([""]), frozenset([""]), needs)

    def all_needs(self) -> Needs:
        """Grams of the strings known, and those met before."""
        parts = [self.needs] + ([_least(map(_of, self.whole))] if self.whole is not None else [_least(map(_of, self.head)), _least(map(_of, self.tail))])
        out = ANYTHING
        for p in parts:
            out = _both(out, p)
        return out

    def then(self, other: _Part) -> _Part:
        needs = _both(self.needs, other.needs)
        if self.whole is not None and other.whole is not None and len(self.whole) * len(other.whole) <= SPELLED:
            own = frozenset(a + b for a, b in product(self.whole, other.whole))
            return _Part(own, own, own, needs)
        seam = frozenset(a[-2:] + b[:2] for a, b in product(self.tail, other.head))
        if len(seam) <= ALTERNATIVES:
            needs = _both(needs, _least(map(_of, seam)))
        head, tail = self.head, other.tail
        if self.whole is not None:
            needs = _both(needs, _least(map(_of, self.whole)))
            if len(self.whole) * len(other.head) <= SPELLED:
                head = frozenset(a + b for a, b in product(self.whole, other.head))
        if other.whole is not None:
            needs = _both(needs, _least(map(_of, other.whole)))
            if len(self.tail) * len(other.whole) <= SPELLED:
                tail = frozenset(a + b for a, b in product(self.tail, other.whole))
        return _Part(None, head, tail, needs)

    def either(self, other: _Part) -> _Part:
        if self.whole is not None and other.whole is not None and len(self.whole | other.whole) <= SPELLED:
            return _Part(self.whole | other.whole, self.whole | other.whole, self.whole | other.whole, _least(self.needs | other.needs))
        needs = _least(self.all_needs() | other.all_needs())
        return _Part.unknown(needs if len(needs) <= ALTERNATIVES else ANYTHING)


def regex_needs(pattern: str) -> Needs:
    """Grams that every text holds in which the pattern is found; ``ANYTHING`` if none is certain or it can't be read."""
    parser = re._parser  # the parse tree of the standard library's patterns
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ANYTHING

    def sequence(items) -> _Part:
        out = _Part.of([""])
        for op, value in items:
            out = out.then(part(str(op), value))
        return out

    def part(op: str, value) -> _Part:
        if op == "LITERAL":
            return _Part.of([chr(value).lower()])
        if op == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= SPELLED:
            return _Part.of(chr(v).lower() for _, v in value)
        if op == "AT" or op == "ASSERT_NOT":
            return _Part.of([""])
        if op == "SUBPATTERN":
            return sequence(value[3])
        if op == "ATOMIC_GROUP":
            return sequence(value)
        if op == "BRANCH":
            branches = [sequence(b) for b in value[1]]
            out = branches[0]
            for b in branches[1:]:
                out = out.either(b)
            return out
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, items = value
            inner = sequence(items)
            if low == high == 1:
                return inner
            if low == 0:
                return _Part.of(["", *inner.whole]) if high == 1 and inner.whole is not None and len(inner.whole) < SPELLED else _Part.unknown()
            return _Part(None, inner.head, inner.tail, inner.all_needs())
        return _Part.unknown()  # a class, any character, a look-ahead, a reference

    return sequence(tree).all_needs()


def literal_needs(text: str) -> Needs:
    return frozenset([_of(text)])


def build(files: DataFrame, folder: str) -> None:
    """Write the index of ``files`` (path, text) to ``folder``, in any store that Spark writes; null texts are empty."""
    block = F.pmod(F.xxhash64("path"), F.lit(BLOCKS)).cast("int").alias("block")
    files.select("path", F.coalesce("text", F.lit("")).alias("text"), block).repartition(BLOCKS, "block").write.partitionBy("block").mode("overwrite").parquet(f"{folder}/texts")
    texts = files.sparkSession.read.parquet(f"{folder}/texts")
    rows = texts.select("path", "block", F.explode(grams(F.col("text"))).alias("gram"))
    shard = F.pmod(F.xxhash64("gram"), F.lit(SHARDS)).cast("int")
    dealt = rows.withColumn("shard", shard).repartition(SHARDS * SPREAD, "shard", F.pmod(F.xxhash64("path"), F.lit(SPREAD))).sortWithinPartitions("shard", "gram")
    dealt.write.partitionBy("shard").mode("overwrite").parquet(f"{folder}/postings")
    postings = files.sparkSession.read.parquet(f"{folder}/postings")
    postings.groupBy("gram").agg(F.count("*").alias("files")).repartitionByRange(F.col("gram")).write.mode("overwrite").parquet(f"{folder}/grams")


class TrigramIndex:
    """A written index, and the candidate files of queries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.texts, self.postings, self.counts = (spark.read.parquet(f"{folder}/{t}") for t in ("texts", "postings", "grams"))

    def asked(self, needs: Needs) -> list[list[str]] | None:
        """For each alternative its rarest grams; alternatives with a gram that no file has are left out; None asks for all files."""
        if not all(needs):
            return None
        every = sorted({g for a in needs for g in a})
        known = {r.gram: r.files for r in self.counts.where(F.col("gram").isin(every)).collect()}  # at most a row a gram of the query
        return [sorted(a, key=lambda g: (known[g], g))[:RAREST] for a in needs if a <= known.keys()]

    def candidates(self, needs: Needs) -> DataFrame | None:
        """(path, block) of files that hold all looked-up grams of one alternative; None means all files."""
        asked = self.asked(needs)
        if asked is None:
            return None
        if not asked:
            return self.texts.select("path", "block").limit(0)
        every = sorted({g for a in asked for g in a})
        shards = [r[0] for r in self.spark.createDataFrame([(g,) for g in every], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(SHARDS)).cast("int")).distinct().collect()]  # at most SHARDS
        rows = self.postings.where(F.col("shard").isin(shards) & F.col("gram").isin(every))
        flags = [F.bool_or(F.col("gram") == g).alias(f"g{i}") for i, g in enumerate(every)]
        held = rows.groupBy("path", "block").agg(*flags)
        some = F.lit(False)
        for a in asked:
            whole = F.lit(True)
            for g in a:
                whole = whole & F.col(f"g{every.index(g)}")
            some = some | whole
        return held.where(some).select("path", "block")

    def files(self, needs: Needs) -> DataFrame:
        """(path, text) of the candidates; only their blocks are read."""
        found = self.candidates(needs)
        if found is None:
            return self.texts.select("path", "text")
        found = found.persist()
        blocks = [r[0] for r in found.select("block").distinct().collect()]  # at most BLOCKS
        return self.texts.where(F.col("block").isin(blocks)).join(found.select("path"), "path", "left_semi").select("path", "text")

    def literal(self, text: str) -> DataFrame:
        """Candidate files of a literal, whatever its case; scans of ``search`` take them for files."""
        return self.files(literal_needs(text))

    def regex(self, pattern: str) -> DataFrame:
        """Candidate files of a pattern."""
        return self.files(regex_needs(pattern))
