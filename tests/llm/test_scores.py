import math
import random
import zlib

import pytest

from corpuscle.llm import op2_toxicity, op5_quality
from corpuscle.llm.automaton import FuzzyLexicon, allowed_edits

DATA = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_what_edit_distance_says():
    terms = ["clown", "scum", "worthless", "trash", "thrash", "abcdefghij"]
    lexicon = FuzzyLexicon(terms)
    words = {"clown", "clwn", "cloown", "clxwn", "lown", "scu", "scum", "worthles", "wrthlss", "orthless", "trahs", "thash", "abdefgij", "abcdefghijkl", "", "zzz", "trrash", "thrashh"}
    words |= {t[:i] + c + t[j:] for t in terms for i in range(len(t) + 1) for j in (i, i + 1) for c in ("", "q")}
    for word in words:
        near = [(distance(word, t), i) for i, t in enumerate(lexicon.terms) if distance(word, t) <= allowed_edits(t)]
        assert lexicon.find(word) == min(near, default=None), word


def test_quotation_counts_less_than_abuse():
    scorer = op2_toxicity.Scorer([(t, 3.0) for t in op2_toxicity.SEED_TERMS])
    abuse, quoted = scorer.figures("you are an idiot and a m0ron"), scorer.figures('he said "you are an idiot" yesterday')
    assert abuse[0] > 0 and abuse[1] > 0 and abuse[2] == 0
    assert quoted[0] == 0 and quoted[2] > 0
    assert scorer.figures("") == (0.0,) * len(op2_toxicity.COLUMNS)


@pytest.mark.parametrize(("module", "label", "least"), [(op2_toxicity, "toxic", 0.94), (op5_quality, "quality", 0.99)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = module.fit(docs, labels).score(docs).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r.score for r in rows if r[label] == 1], [r.score for r in rows if r[label] == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= least
    assert sum(r.predicted != r[label] for r in rows) <= 0.03 * len(rows)


@pytest.mark.parametrize("module", [op2_toxicity, op5_quality])
def test_edge_rows(spark, module):
    schema = "doc_id long, text string, score int, y int, kept string, exact int"
    docs = spark.createDataFrame([(1, None, 1, 1, "", 1), (None, "", 1, 1, "", 1), (2, "x" * 300_000, 1, 1, "", 1), (2, "x " * 100_000, 1, 1, "", 1), (2, "x " * 100_000, 1, 1, "", 1)], schema)
    for labels in (spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")):
        rows = module.fit(docs, labels).score(docs).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert module.fit(docs.limit(0), labels).score(docs.limit(0)).count() == 0


def naive_look(word, terms, stems):
    """As ``Scorer.look``, term by term."""
    if word in terms:
        return terms[word], True
    begun = [w for s, w in stems.items() if word.startswith(s)]
    if begun:
        return max(begun), True
    for form in (word, word.translate(op2_toxicity.LEET)) if any(c in "013457@$*" for c in word) and not word.isdigit() else (word,):
        near = [(distance(form, t), t) for t in sorted(terms) if distance(form, t) <= allowed_edits(t)]
        if near:
            d, t = min(near)
            return terms[t] / (1 + d), False
    return None


def test_figures_against_all_terms():
    rng = random.Random(3)
    terms = {"clown": 3.0, "worthless": 2.5, "trash": 3.5, "scum": 3.0, "thrash": 1.0, "abominable": 4.0}
    stems = {"clow": 2.0, "patheti": 2.2, "tras": 1.5, "wort": 0.7}
    scorer = op2_toxicity.Scorer([*terms.items(), *((s + "*", w) for s, w in stems.items())])
    letters = "abcdefghilmnoprstwxyz04@"

    def word():
        w = list(rng.choice([*terms, *stems, "harmless", "word", "a"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
        return "".join(w)

    for _ in range(300):
        words = [w for w in (word() for _ in range(rng.randint(0, 40))) if op2_toxicity.WORD.fullmatch(w)]
        hits = {i: naive_look(w, terms, stems) for i, w in enumerate(words)}
        hits = {i: h for i, h in hits.items() if h is not None}
        exact, fuzzy = sum(h[1] for h in hits.values()), sum(not h[1] for h in hits.values())
        near = max((min(2 * op2_toxicity.WINDOW, sum(i <= j <= i + 2 * op2_toxicity.WINDOW for j in hits)) for i in hits), default=0)
        want = (math.log1p(exact), math.log1p(fuzzy), 0.0, max((h[0] for h in hits.values()), default=0.0), math.log1p(near), math.log1p(1000 * exact / max(1, len(words))))
        assert scorer.figures(" ".join(words)) == pytest.approx(want), words


def test_weights_keep_the_base_rate(spark):
    """A sample of as many rows of each class scores like all rows."""
    rng = random.Random(4)
    text = lambda good: " ".join(rng.choice(["lorem", "ipsum", "dolor"] if good else ["##", "!!", "lorem"]) for _ in range(30))
    ids = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, i % 10 != 0, text(i % 10 != 0 or rng.random() < 0.5)) for i in ids]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y, _ in rows], "doc_id long, quality int")
    mean = lambda model: model.score(docs).agg({"score": "avg"}).first()[0]
    assert abs(mean(op5_quality.fit(docs, labels)) - 0.9) < 0.03 and abs(mean(op5_quality.fit(docs, labels, per_class=100)) - 0.9) < 0.06


def test_sample_takes_one_row_an_id(spark):
    from corpuscle.llm.labelled import sample

    docs = spark.range(50_000).selectExpr("1L AS doc_id", "concat('text ', id % 7) AS text").unionByName(spark.createDataFrame([(2, "other"), (6, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    rows = sample(docs, labels, "toxic", 10).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and {r.doc_id for r in rows} <= {1, 2, 6}
