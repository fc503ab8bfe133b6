import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.llm import op12_resampling as op
from corpuscle.llm.grams import buffers

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets_of(text, longest=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, least=20, percent=25):
    docs = [(i, *buckets_of(t)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in buckets_of(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0))))
    out = []
    for i, n_words, found in docs:
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    ranks = {x[0]: r for r, x in enumerate(able[: len(able) * percent // 100], 1)}
    return [(*x[:4], ranks.get(x[0])) for x in out]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\n.9x", max_size=30), max_size=8), st.integers(1, 5))
def test_occurrences(texts, longest):
    data, at = buffers(pa.array(texts, pa.string()))
    n_words, owner, bucket = op.occurrences(data, at, longest, 10000)
    want = [buckets_of(t, longest) for t in texts]
    assert n_words.tolist() == [n for n, _ in want]
    for i, (_, found) in enumerate(want):
        assert sorted(bucket[owner == i].tolist()) == sorted(found)


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(1)
    ids, left = rng.integers(0, 3, 60), np.concatenate([np.arange(25, 0, -1), np.arange(35, 0, -1)])
    for longest in (1, 2, 3, 4, 7):
        suffix = [tuple(ids[i : i + min(longest, left[i])]) for i in range(60)]
        order = op.suffix_order(ids.copy(), left, longest)
        assert [suffix[i] for i in order] == sorted(suffix)
        shared = op.common_prefixes(order, ids, left, longest)
        for a, b, k in zip(order[:-1], order[1:], shared, strict=True):
            same = [x == y for x, y in zip(suffix[a], suffix[b], strict=False)]
            assert k == (same.index(False) if False in same else len(same))


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    names = ["alpha", "Beta", "gamma", "élan", "42", "x"]
    rows = [(i, " ".join(rng.choice(names, rng.integers(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "... !!"), (None, " ".join(["alpha"] * 30)), (1003, "beta gamma " * 40_000)]
    target = ["gamma gamma élan", "Alpha-beta", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("other")).withColumn("n_words", F.lit(1)).repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = op.resample(docs, items)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted((tuple(r)[0:1] + tuple(r)[2:] for r in got.collect()), key=key) == sorted(brute(rows, target), key=key)
    drawn = op.draw(docs, items)
    assert drawn.columns == docs.columns and drawn.count() == got.where("rank IS NOT NULL").count()


def test_copies_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(5, text)] * 400 + [(6, text + " more"), (7, "few words")], "doc_id long, text string")
    out = op.resample(docs, docs.limit(0)).collect()
    assert len(out) == 402 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 101))
    assert len({(r.doc_id, r.score) for r in out}) == 3 and all(r["rank"] is None for r in out if r.doc_id == 7)
    assert op.resample(docs.limit(0), docs).count() == 0
