import random

from pyspark.sql import functions as F

from corpuscle.llm import op7_topk as topk


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, rng.gauss(0, 0.2)]) for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(30)]
    odd = [(800, None), (None, [1.0] * 8), (801, [1.0, None] * 4), (802, [float("nan")] * 8), (803, [float("inf")] * 8), (804, []), (810, [3.0, 4.0]), (820, [1.0, 2.0]), (100, rows[100][1])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows + odd], "vec_id long, embedding array<double>, score int, v int")
    vectors = topk.to_integers(df)
    clean = [(i, [int(1024 * x // 1) for x in v]) for i, v in rows + odd[-3:]]
    got = topk.top_k(vectors, F.col("vec_id") % 10 == 0).collect()
    queries = dict(q for q in clean if q[0] % 10 == 0)
    want = set()
    for q, v in queries.items():
        near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v))
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(near[:10], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    assert {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 10 == 0).collect()} == want
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_query_rows_of_one_id(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.25]), (3, [0.5, 0.0])]
    vectors = topk.to_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") == 100, 2).orderBy("query_id", "rank", "vec_id").collect()]
    assert sorted(got) == sorted([(100, 1, 1, 2**19), (100, 2, 3, 2**19), (100, 1, 2, 2**18), (100, 2, 1, 0)])


def test_many_equal_vectors_and_large_components(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, [1e9, -1e11, 3.0]) for i in range(3)]
    vectors = topk.to_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {tuple(r) for r in topk.top_k(vectors.repartition(5), F.col("vec_id").isin(0, 2000, 5001), 4).collect()}
    same = 1024 * 1024 * 14
    want = {(0, r, r, same) for r in range(1, 5)} | {(2000, r, r - 1, same) for r in range(1, 5)}
    far = -2 * 10**11 * 1024 * 1024 + 10**9 * 1024 * 1024 + 9 * 1024 * 1024
    want |= {(5001, 1, 5000, 2**63 - 1), (5001, 2, 5002, 2**63 - 1)} | {(5001, r, r - 3, far) for r in (3, 4)}
    assert got == want


def test_components_of_any_size(spark):
    """Finite components take part, whatever their size; integers and scores are held within 64 bits."""
    rows = [(100, [1.0, 2.0]), (1, [3e12, 0.0]), (2, [5.0, 5.0]), (3, [-(2.0**52), 2.0**51]), (4, [2.0**52, -(2.0**51)]), (5, [1e300, -1e300]), (6, [-1e300, 1.0]), (200, [-(2.0**30), 2.0**31 + 0.5])]
    rng = random.Random(9)
    rows += [(i, [rng.choice([-1, 1]) * 2.0 ** rng.uniform(0, 60), rng.gauss(0, 1)]) for i in range(301, 380)]
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    ints = [(i, [max(-(2**63 - 1), held(int(x) * 1024 if abs(x) >= 2**53 else int(1024 * x // 1))) for x in v]) for i, v in rows]
    vectors = topk.to_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {(r.vec_id, tuple(r.v)) for r in vectors.collect()} == {(i, tuple(v)) for i, v in ints}
    want = set()
    for q, v in ints:
        if q % 100 == 0:
            near = sorted((-held(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in ints if i != q)
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(near[:10], 1)}
    assert {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0).collect()} == want
