import random

import pyarrow as pa

from corpuscle.llm import grams
from corpuscle.llm import op10_decontaminate as deco

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(3000)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def best(document, item, least, wrong):
    """Longest stretch of any alignment, by trying all."""
    out = 0
    for shift in range(-len(item), len(document)):
        equal = [document[k] == item[k - shift] for k in range(max(0, shift), min(len(document), shift + len(item)))]
        for i in range(len(equal)):
            for j in range(len(equal), i + max(least, out) - 1, -1):
                if equal[i] and equal[j - 1] and sum(equal[i:j]) >= (1 - wrong) * (j - i):
                    out = max(out, j - i)
                    break
    return out


def test_finds_what_alignment_finds(spark):
    items = [prose(40) for _ in range(12)] + [["one", "short", "item"], []]
    docs, kinds = [], []
    for i in range(120):
        item = items[i % 12]
        kind = i % 6
        body = prose(RNG.randint(0, 60))
        if kind == 1:
            body = body + item + prose(20)
        elif kind == 2:  # every seventh word replaced
            body = body + [RNG.choice(WORDS) if k % 7 == 3 else w for k, w in enumerate(item)] + prose(5)
        elif kind == 3:
            body = body + item[10:26] + prose(5)
        elif kind == 4:
            body = body + item[:9] + prose(30)
        docs.append(body)
        kinds.append(kind)
    text = [" ".join(w.capitalize() if k % 9 == 0 else w + "," if k % 5 == 0 else w for k, w in enumerate(d)) for d in docs]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(text)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(x), 1) for i, x in enumerate(items)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r.contaminated for r in deco.judge(df, bench).collect()}
    for i, d in enumerate(docs):
        assert got[i] == any(best(d, x, min(deco.LEAST, len(x)), deco.WRONG) >= min(deco.LEAST, len(x)) for x in items if x), (i, kinds[i])


def test_alignment_is_the_longest():
    for _ in range(200):
        item = [RNG.choice("abc") for _ in range(24)]
        document = [RNG.choice(["a", "b", "c", item[k]]) for k in range(24)]
        h = {c: v for c, v in zip("abc", next(iter([grams.words(*list(grams.chunks(pa.array(["a b c"])))[0][2:], grams.NOT_WORD)[3]])), strict=True)}
        d, x = (__import__("numpy").array([h[c] for c in w]) for w in (document, item))
        same = [p == q for p, q in zip(document, item, strict=True)]
        place = RNG.choice([k for k in range(24) if same[k]] or [-1])
        if place < 0:
            continue
        a, b, equal = deco.aligned(d, x, 0, place, 3, 0.2)
        want = max((j - i for i in range(24) for j in range(i + 3, 25) if i <= place < j and same[i] and same[j - 1] and sum(same[i:j]) >= 0.8 * (j - i) - 1e-9), default=0)
        assert b - a == want and equal == sum(same[a:b])


def test_edges(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (None, None), (2, ""), (1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (None, "Alpha, beta GAMMA!"), (3, "alpha beta"), (4, "x " * 100_000 + "alpha beta gamma"), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.contaminated) for r in deco.judge(docs, bench).collect()} == {(1, False), (None, True), (3, False), (4, True), (4, False)}
    assert not any(r.contaminated for r in deco.judge(docs, bench.limit(0)).collect())
    assert deco.judge(docs.limit(0), bench).count() == 0


def test_short_items_stand_a_substitution(spark):
    eight, ten, seven = ([f"{c}{k}" for k in range(n)] for c, n in (("e", 8), ("t", 10), ("s", 7)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((eight, ten, seven))], "item_id long, text string")
    swap = lambda x, k: ["before", *x[:k], "other", *x[k + 1 :], "after"]
    docs = [swap(eight, 3), swap(ten, 2), swap(ten, 5), eight, ten, seven, prose(30)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    assert [r.contaminated for r in deco.judge(df, bench).orderBy("doc_id").collect()] == [True] * 6 + [False]


def test_rows_that_repeat_an_id_are_judged_each(spark):
    passage, own = " ".join(f"word{i}" for i in range(20)), "nothing of the kind here"
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(None, passage), (None, own), (9, passage), (9, passage), (9, own)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.contaminated, r.n_items, r.n_words) for r in deco.judge(docs, bench).collect()), key=str)
    assert got == sorted([(None, True, 1, 20), (None, False, 0, 0), (9, True, 1, 20), (9, True, 1, 20), (9, False, 0, 0)], key=str)


def test_repeated_words(spark):
    bench = spark.createDataFrame([(1, "the " * 60), (2, "a b " * 30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the " * 3000), (2, "one the two " * 500), (3, "b a " * 400)], "doc_id long, text string")
    assert {(r.doc_id, r.contaminated) for r in deco.judge(docs, bench).collect()} == {(1, True), (2, False), (3, True)}


def test_one_word_repeated_in_item_and_text(spark, monkeypatch):
    """Places of one diagonal are one hit, and the answer is what alignment of all of them gives."""
    index = deco.Index([(1, "x " * 400), (2, "x y " * 30), (3, " ".join(prose(40)))])
    text = pa.array(["x " * 3000, "y x " * 500 + "x " * 50, "x " * 12 + "y " * 12, " ".join(prose(50))])
    found = list(deco.Finder(index).find(text))
    assert {h[0] for h in found[0]} == {1} and (1, 0, 400, 400) in found[0] and (1, 2600, 3000, 400) in found[0]
    assert 2 in {h[0] for h in found[1]} and found[2] == [] and {h[0] for h in found[3]} <= {3}
    monkeypatch.setattr(deco, "HITS", 7)
    assert list(deco.Finder(index).find(text.slice(1))) == found[1:]
