import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import op11_whitening, queries


def brute(vectors, scale=256, k=4):
    """n, S, eigenvalues, components of the distinct integer vectors, by covariance in Python's integers."""
    xs = [tuple(math.floor(scale * float(c)) for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, right = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, sums, values[::-1], right[:, ::-1][:, :k]


def held(spark, vectors, rows, k=4):
    xs, n, sums, values, right = brute(vectors, k=k)
    assert len(rows) == len(xs) * right.shape[1]
    by = {(r.vec_id, r.component): r for r in rows}
    for j in range(right.shape[1]):
        want = np.array([sum((n * a - s) / n * w for a, s, w in zip(x, sums, right[:, j], strict=True)) for x in xs]) / math.sqrt(values[j])
        got = np.array([by[i, j + 1].whitened for i in range(len(xs))])
        sign = 1 if got @ want > 0 else -1
        assert np.allclose(sign * got, want, atol=1e-7)
        assert all(by[i, j + 1].deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in enumerate(xs))
        assert by[0, j + 1].explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
    assert {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-9 and len({r.identity_error for r in rows}) == 1


def test_against_covariance(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))).tolist()
    vectors += [vectors[3]] * 150  # copies are in the fit list once
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(23)
    held(spark, vectors, op11_whitening.whiten(df).collect())


def test_query_on_floats(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    good = [r for r in table if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    rows = queries.queries()["op11_whitened_embeddings"](spark, sf).collect()
    at = {r.vec_id: i for i, r in enumerate(good)}
    assert len(at) == len(good)
    held(spark, [r.embedding for r in good], [type(r)(**(r.asDict() | {"vec_id": at[r.vec_id]})) for r in rows])


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -0.25]), (2, [3.0]), (3, []), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [-inf, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("other")).withColumn("component", F.lit("other"))
    out = op11_whitening.whiten(df).collect()
    assert len(out) == 2 * 5 and {r.vec_id for r in out} == {1, None, 2, 3}
    assert {r.n for r in out} == {4} and {r.component for r in out} == {1, 2}
    zeros = [r for r in out if r.vec_id == 3][0]
    sums = [256 * (1 + 3) + 128, 256 * 2 - 64]
    assert zeros.deviation == sums[0] ** 2 + sums[1] ** 2


def test_no_extent(spark):
    schema = "vec_id long, embedding array<float>"
    out = op11_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], schema)).collect()
    assert [(r.vec_id, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(out) if r.component == 1] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    line = op11_whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(50)], schema)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-12
    for empty in ([], [(1, None)], [(1, [])]):
        assert op11_whitening.whiten(spark.createDataFrame(empty, schema)).count() == 0


def test_large_numbers(spark):
    rows = [(i, [float(2**40) * (i % 7), float(i) * 2**33, -(2.0**45) * (i % 5)]) for i in range(60)] + [(60, [1e300, 0.0, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    xs = [[max(-(2**63), min(2**63 - 1, math.floor(256 * c) if abs(c) < 1e299 else int(math.copysign(2**70, c)))) for c in v] for _, v in rows]
    n, sums = len({tuple(x) for x in xs}), [sum(c) for c in zip(*{tuple(x) for x in xs}, strict=True)]
    want = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    out = {r.vec_id: r for r in op11_whitening.whiten(df).where("component = 1").collect()}
    assert [out[i].deviation for i in range(61)] == [w if w < 2**63 else None for w in want]
    mid = spark.createDataFrame(rows[:60], "vec_id long, embedding array<double>").select("vec_id", F.transform("embedding", lambda c: c / 2**36).alias("embedding"))
    held(spark, [[c / 2**36 for c in v] for _, v in rows[:60]], op11_whitening.whiten(mid).collect())
