"""The stages by their decisions, each on its own input."""

import random

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    words = ["".join(rng.choice("opqrst") for _ in range(5)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    near = [prose(12) for _ in range(10)]
    extra = [
        (900_001, "You idiot, you stupid moron. " + prose(30)),
        (900_002, prose(40) + "\n" + passage),
        (900_003, "\n".join(near)),
        (900_004, "\n".join([*near[:9], prose(6)])),
        (900_005, None),
        (900_006, prose(50)),
    ]
    more = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in extra], base.schema)
    docs = base.unionByName(more)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.schema.names == docs.schema.names
        left[name], before = ids(out), ids(docs)
        assert left[name] <= before
        docs = out
    assert 900_001 not in left["toxicity"] and {900_002, 900_003, 900_005, 900_006} <= left["toxicity"]
    assert left["line_dedup"] <= left["toxicity"] and {900_002, 900_003, 900_004, 900_005, 900_006} <= left["line_dedup"]
    assert 900_002 not in left["decontaminate"] and 900_006 in left["packing"]
    assert len(left["packing"]) > 150


def test_near_stage_keeps_the_first_of_a_group(spark):
    rng = random.Random(3)
    w = ["".join(rng.choice("uvwxyz") for _ in range(4)) for _ in range(200)]
    other = [*w[:199], "changed"]
    docs = spark.createDataFrame([(5, " ".join(w)), (3, " ".join(other)), (9, " ".join(w)), (None, " ".join(w)), (7, "alone in the world today")], "doc_id long, text string")
    assert sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=str) == [3, 7, None]


FILTERS = [(name, stage) for name, stage in corpus_pipeline.STAGES if name != "packing"]


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_filters_judge_rows_not_ids(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("ghijkl") for _ in range(5)) for _ in range(n))
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    own = [prose(40) for _ in range(6)]
    bad = "You idiot, you stupid moron. You worthless pathetic loser. " + own[0]
    rows = [(1, own[1]), (5, own[1]), (5, own[2]), (None, own[3]), (None, None), (7, bad), (7, own[4]), (9, passage), (9, own[5]), (10, "")]
    docs = spark.createDataFrame([(*r, "z", 4, "en") for r in rows], "doc_id long, text string, component string, row int, lang string")
    kept = {name: stage(spark, docs, DATA) for name, stage in FILTERS}
    assert all(df.columns == docs.columns for df in kept.values())
    assert texts(kept["toxicity"]) == sorted((r for r in rows if r[1] != bad), key=str)
    assert texts(kept["line_dedup"]) == sorted((r for r in rows if r != (5, own[1])), key=str)
    assert texts(kept["near_dedup"]) == sorted((r for r in rows if r != (5, own[1])), key=str)
    assert texts(kept["decontaminate"]) == sorted((r for r in rows if r[1] != passage), key=str)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(stage(spark, docs, DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_near_dedup_works_behind_line_dedup(spark):
    """Copies with another order of words in every line are no similar lines, but similar documents."""
    rng = random.Random(9)
    words = ["".join(rng.choice("mnopqr") for _ in range(6)) for _ in range(300)]
    cut = lambda at: "\n".join(" ".join(words[i : i + 9]) for i in range(at, 300, 9))
    docs = spark.createDataFrame([(1, cut(0)), (2, cut(4)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    lines = corpus_pipeline.line_dedup(spark, docs, DATA)
    assert {r.doc_id for r in lines.collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, lines, DATA).collect()} == {1, 3}


def test_run_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    columns = ["doc_id", "piece", "n_tokens", "capacity"]
    rows = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    got = corpus_pipeline.run(spark, DATA)
    assert rows(got) == rows(docs) and got.count() > 100
