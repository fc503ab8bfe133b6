import random
import re

from pyspark.sql import functions as F

from corpuscle.llm import cut, op8_neardup
from corpuscle.llm.components import components, extended
from corpuscle.llm.prefix import close_buckets, links_by_prefix


def expected(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    docs, i = [], 0
    for size in (5, 20, 150, 500):  # groups of near copies, of chained edits too
        for _ in range(3):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(15):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    w[rng.randrange(size)] = rng.choice(words)
                if rng.random() < 0.2:
                    base = w
                docs.append((i, (" " if rng.random() < 0.5 else "\n").join(w)))
                i += 1
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(60):
        docs.append((i, " ".join([rng.choice(words) for _ in range(40)]) + " " + passage))
        i += 1
    return docs + [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two"), (i + 6, "x " * 30000), (i + 7, "X\v" * 20000)]


def test_against_brute_force(spark, monkeypatch):
    for seed, n, percent in ((1, 3, 85), (2, 5, 80)):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, 1) for i, t in docs], "doc_id long, text string, n int, keys int")
        assert {tuple(r) for r in op8_neardup.near_duplicates(df, n, percent).drop("row").collect()} == expected(docs, n, percent)
    monkeypatch.setattr(op8_neardup, "FEW", 3)
    monkeypatch.setattr(cut, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in op8_neardup.near_duplicates(df, n, percent).drop("row").collect()} == expected(docs, n, percent)


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (7, text), (7, "other words here now"), (8, "other words here now")], "doc_id long, text string")
    got = sorted((tuple(r) for r in op8_neardup.near_duplicates(df).drop("row").collect()), key=str)
    assert got == sorted([(None, 5, None, True), (4, 5, 4, True), (4, 5, 4, True), (7, 5, 4, False), (7, 2, 7, True), (8, 2, 7, False)], key=str)
    assert op8_neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, i) for i in range(201, 230)]
    rng.shuffle(links)
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in parent if find(x) != x}


def test_one_large_component_and_outliers(spark):
    """Joins grow with the open pairs, not with a component's square."""
    n, asked = 300_000, []
    members = spark.range(n + 2).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("node"))
    links = spark.range(1, n).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))

    def confirmed(pairs):
        asked.append(pairs.count())
        return pairs.limit(0)

    sets = lambda nodes: nodes.select("node", F.array(F.lit(1).cast("long"), -F.col("node") - 2, -F.col("node") - 10**9).alias("grams"))
    with cut.Scratch(spark) as scratch:
        assert close_buckets(members, cut.cut(links), 80, 4, confirmed, sets, scratch).count() == n - 1
    assert sum(asked) == 2 * n + 1  # either outlier and all others


def test_prefix_lists_of_one_family(spark):
    """A value that all sets of one component share meets only the others."""
    n, asked = 40_000, []
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    links = spark.range(1, n).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))

    def confirmed(pairs):
        asked.append(pairs.count())
        return pairs.limit(0)

    sets = nodes.select("node", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("grams"))
    with cut.Scratch(spark) as scratch:
        links_by_prefix(nodes.withColumn("key", F.lit(1)), scratch.table(sets), cut.cut(links), 80, confirmed, scratch)
    assert asked[-1] == n


def test_values_of_one_component_are_not_ordered(spark):
    """Sets that share values only within their component take no part; those that share one with others do."""
    ordered = []

    class Watched(cut.Scratch):
        def table(self, df):
            out = super().table(df)
            if "typical" in df.columns:
                ordered.append({r.node for r in out.collect()})
            return out

    links = cut.cut(spark.createDataFrame([(k, 0) for k in range(1, 50)], "a long, b long"))
    rows = [(k, [1, 2, 3, 4, 100 + k]) for k in range(49)] + [(49, [1, 2, 3, 4, 900]), (50, [900, 901, 902])]
    sets = spark.createDataFrame(rows, "node long, grams array<long>")
    with Watched(spark) as scratch:
        links_by_prefix(sets.select(F.lit(1).alias("key"), "node"), scratch.table(sets), links, 80, lambda pairs: pairs.limit(0), scratch)
    assert ordered == [{49, 50}]


def jobs_of(spark, work):
    """What ``work`` returns, and the number of jobs it took."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_small_graphs_take_few_jobs(spark, monkeypatch):
    """A small graph's rounds broadcast what they look up; larger ones shuffle, with the same components."""
    links = cut.cut(spark.createDataFrame([(i, i // 3) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(30)], "a long, b long"))
    small, n_small = jobs_of(spark, lambda: {tuple(r) for r in components(links).collect()})
    monkeypatch.setattr("corpuscle.llm.components.FEW_LINKS", 0)
    large, n_large = jobs_of(spark, lambda: {tuple(r) for r in components(links).collect()})
    assert small == large == {(i, 0) for i in range(1, 400)} | {(1001 + i, 1000) for i in range(30)}
    assert n_small < n_large


def test_buckets_extend_the_labels_they_have(spark, monkeypatch):
    """Components of all links are found once; what is found later is worked on between components only."""
    asked = []
    monkeypatch.setattr("corpuscle.llm.prefix.components", lambda links, scratch: asked.append(1) or components(links, scratch))
    members = spark.createDataFrame([(1, k) for k in range(6)], "key long, node long")
    links = cut.cut(spark.createDataFrame([(1, 0), (3, 2), (5, 4)], "a long, b long"))
    sets = lambda nodes: nodes.select("node", F.array(F.col("node")).alias("grams"))
    with cut.Scratch(spark) as scratch:
        out = close_buckets(members, links, 80, 64, lambda pairs: pairs.where("b = 0 OR a = 5 AND b = 2"), sets, scratch)
        assert {tuple(r) for r in out.collect()} == {(k, 0) for k in range(1, 6)}
    assert len(asked) == 1


def test_size_estimates_do_not_multiply(spark):
    """What rounds and later links keep has the size of its rows for the planner."""
    links = spark.createDataFrame([(i, i // 2) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(30)], "a long, b long")
    with cut.Scratch(spark) as scratch:
        labels = components(links, scratch)
        for k in range(3):
            labels = extended(labels, spark.createDataFrame([(1000 + 10 * k, k)], "a long, b long"), scratch)
        assert int(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 20
        assert labels.count() == 330
