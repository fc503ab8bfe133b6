import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import op13_mixing as op


def brute(rows, quality=None, weights=(5, 2, 1), percent=150, most=2):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), n) for n, (i, s, t) in enumerate(rows)]
    size = defaultdict(int)
    for _, s, k, _ in docs:
        size[s] += k
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: weights[j % len(weights)] for j, s in enumerate(names)}
    target, open_, budget = {}, set(names), percent * sum(size.values()) / 100
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * size[s]}
        target |= {s: most * size[s] for s in full} | {s: level * weight[s] for s in open_ - full}
        budget -= sum(most * size[s] for s in full)
        open_ = open_ - full if full else set()
    out = {}
    for s in names:
        rest, whole = 0, math.floor(target[s])
        epochs = whole // size[s] if size[s] else 0
        rest = whole - epochs * size[s]

        def key(d):
            h = int(hashlib.sha256(f"mix:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:12], 16)
            return -math.log((h + 0.5) / 2**48) / ((quality or {}).get(d[0], 2.0) if quality is not None else 1.0), d[0] is None, d[0]

        for d in sorted((d for d in docs if d[1] == s), key=key):
            part = max(0, min(d[2], rest))
            rest -= part
            out[d[3]] = (d[0], d[1], d[2], size[s], target[s], epochs * d[2] + part)
    return [out[n] for n in sorted(out)]


def rows_of(n=300):
    rows = [(i, f"src{i * i % 11}", " ".join(["w"] * (i * 7 % 23))) for i in range(n)]
    return rows + [(1000, None, "a b\tc"), (1001, None, None), (1002, "", "x y z"), (1003, "hot", "long " * 20_000), (None, "src0", "one two")] + [(2000 + i, "hot", "a b c") for i in range(200)]


@pytest.mark.parametrize("weights,percent,most", [((5, 2, 1), 150, 2), ((1,), 100, 1), ((3, 1), 40, 1), ((5, 2, 1), 500, 2)])
def test_against_brute_force(spark, weights, percent, most):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("taken", F.lit("other")).withColumn("size", F.lit(None).cast("int")).repartition(4)
    quality = {i: 4.0 if i % 3 else 1.0 for i in range(0, 300, 2)}
    known = spark.createDataFrame(list(quality.items()), "doc_id long, weight double")
    out = op.mix(docs, known, weights, percent, most)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r)[:1] + tuple(r)[2:] for r in out.collect()), key=key)
    want = sorted(brute(rows, quality, weights, percent, most), key=key)
    assert [(*g[:4], g[5]) for g in got] == [(*w[:4], w[5]) for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r[1]] += r[5]
        target[r[1]] = r[4]
        assert r[5] <= most * r[2]
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in taken)


def test_mixed_texts(spark):
    docs = spark.createDataFrame(rows_of(120), "doc_id long, source string, text string").withColumn("epoch", F.lit("other"))
    mixture = op.mix(docs)
    texts = op.mixed_texts(docs, mixture)
    assert texts.columns == ["doc_id", "source", "text", "epoch"]
    counted = {(r.doc_id, r.source): r.n for r in texts.groupBy("doc_id", "source").agg(F.sum(op.word_count(F.col("text"))).alias("n")).collect()}
    assert counted == {(r.doc_id, r.source): r.taken for r in mixture.where("taken > 0").collect()}


def test_copies_reruns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "x y z")] * 500 + [(2, "b", "p q")] * 3 + [(3, "c", None)], "doc_id long, source string, text string")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    one, two = (sorted(map(tuple, op.mix(d).select(*columns).collect()), key=repr) for d in (docs, docs.repartition(7, F.rand(3))))
    assert one == two and len(one) == 504
    assert sum(r[5] for r in one if r[1] == "a") == math.floor(next(r[4] for r in one if r[1] == "a"))
    assert all(r[4] == 0 and r[5] == 0 for r in one if r[1] == "c")
    assert op.mix(docs.limit(0)).count() == 0
    assert op.mixed_texts(docs, op.mix(docs)).count() > 0
    bad = spark.createDataFrame([(1, float("nan")), (2, -1.0)], "doc_id long, weight double")
    assert sorted(map(tuple, op.mix(docs, bad).select(*columns).collect()), key=repr) == one
