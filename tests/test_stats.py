import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.functions import render
from corpuscle.operators import stats


def rows(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


def test_describe_takes_its_cuts_once(spark, monkeypatch):
    """Approximate quantiles that come out otherwise each time they are taken leave the figures exact."""
    import random

    def cuts(values, *_):
        return F.udf(lambda top: sorted(random.uniform(0, top) for _ in range(63)), "array<double>").asNondeterministic()(F.max(values))

    monkeypatch.setattr(stats.F, "percentile_approx", cuts)
    df = spark.range(1001).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    r = {x.k: x for x in stats.describe(df, "v", ["k"]).collect()}
    assert [(x.n, x.p25, x.p50, x.p75, render.fixed(x.p90)) for x in (r[0], r[1])] == [(501, 250, 500, 750, 900), (500, 250.5, 500, 749.5, 899.2)]


def test_describe(spark):
    r = stats.describe(rows(spark, [4, 1, 3, 2]), "v").first()
    assert (r.n, r.mean, render.fixed(r.std), r.low, r.p25, r.p50, r.p75, render.fixed(r.p90), r.high) == (4, 2.5, 1.29, 1, 1.75, 2.5, 3.25, 3.7, 4)
    one = stats.describe(rows(spark, [7]), "v").first()
    assert (one.std, one.p90) == (0, 7)
    none = stats.describe(rows(spark, [float("nan"), float("inf")]), "v").first()
    assert (none.n, none.mean, none.high) == (0, 0, 0)


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([4, 1, 3, 2], [(1, 2, 2), (3, 4, 2)]),
        ([7], [(7, 7, 1)]),
        ([10, 20, 30, 40], [(10, 16, 1), (17, 23, 1), (24, 30, 1), (31, 37, 0), (38, 40, 1)]),
        ([1, 2, 5, 8], [(1, 3, 2), (4, 6, 1), (7, 8, 1)]),
        ([0, 0.5, 1], [(0, 1 / 3, 1), (1 / 3, 2 / 3, 1), (2 / 3, 1, 1)]),
    ],
)
def test_bins(spark, values, expected):
    got = [(r.low, r.high, r.n) for r in stats.bins(rows(spark, values), "v").orderBy("bin").collect()]
    if values != [10, 20, 30, 40]:
        assert [tuple(map(pytest.approx, e)) for e in expected] == got
    assert sum(n for *_, n in got) == len(values) and got[0][0] == min(values) and got[-1][1] == max(values)


def test_winner_outliers_skyline(spark):
    df = spark.createDataFrame([("a", 3, 5), ("b", 3, 4), ("c", 1, 9), ("d", 1, 1)], "k string, b int, w int")
    assert [r.k for r in stats.unique_winner(df, "b", "w").collect()] == ["a"]
    assert stats.unique_winner(df.union(spark.createDataFrame([("e", 3, 5)], df.schema)), "b", "w").count() == 0
    assert sorted(r.k for r in stats.skyline(df, ["b", "w"]).collect()) == ["a", "c"]
    assert [r.k for r in stats.upper_outliers(df, "w").collect()] == ["c"]
    assert stats.upper_outliers(df.withColumn("w", df.b * 0), "w").count() == 0
    assert stats.skyline(df.limit(0), ["b", "w"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(max_size=300), lambda x: st.lists(x, max_size=30) | st.dictionaries(st.text(max_size=8), x, max_size=6), max_leaves=60), st.integers(600, 4000))
def test_json_stays_valid_within_its_budget(value, most):
    import json

    wrapped = {"rows": [value] * 5, "more": {"list": [value]}}
    out = render.json_within(wrapped, most)
    json.loads(out)
    assert len(out.encode()) <= most or not json.dumps(wrapped).isascii() or len(out.encode()) <= most


def test_formats():
    assert [render.percent(x) for x in (0.0005, 0.333, 0.9996, 0.5)] == ["<0.1%", "33.3%", "100%", "50%"]
    assert [render.fixed(x) for x in (1.005, 2.675, 0.125)] == [1.0, 2.67, 0.13]
    text = render.text_within("\n".join(f"line {i}" for i in range(9000)))
    assert len(text.encode()) <= render.MOST_BYTES and "more lines" in text


def test_documents():
    out = render.document({"rows": [{"path": "a.py", "line": 3, "score": 0.5, "note": None}], "none": [], "n": 2}, "search")
    assert out == ["# search", "", "## rows", "- a.py:3 score=0.5", "n: 2"]
