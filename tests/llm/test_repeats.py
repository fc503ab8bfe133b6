import hashlib
import random
from collections import Counter

from corpuscle.llm import op3_repeats


def expected(texts, length):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(n) for n in (60, 75, 90, 130)]
    texts = [(i, prose(rng.randint(1, 60)) + rng.choice(shared) + prose(rng.randint(1, 60))) for i in range(60)]
    long = prose(900)
    for i in range(60, 80):  # near copies of one text
        w = long.split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append((i, " ".join(w)))
    texts += [(90, "a" * 2000), (91, "ab" * 700), (92, "a" * 399), (93, None), (94, ""), (95, "xyz " * 150 + long[:401] + "xyz " * 150), (96, texts[3][1]), (96, texts[3][1]), (None, texts[5][1])]
    return texts


def test_against_brute_force(spark):
    for seed, length in ((1, 400), (2, 400), (3, 50)):
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, d1 int, core int")
        got = Counter(tuple(r) for r in op3_repeats.repeated_strings(df, length).collect())
        assert got == expected(texts, length), (seed, length)


def test_empty_table(spark):
    assert op3_repeats.repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_of_long_texts(monkeypatch):
    """Pieces give the same places as the whole."""
    rng = op3_repeats.np.random.default_rng(4)
    hashes = rng.integers(0, 2**63, 5000, dtype=op3_repeats.np.uint64)
    hashes[1000:1400] = hashes[7]  # ties: the first of equals
    whole = {reach: op3_repeats.smallest(hashes, reach) for reach in (1, 64, 273)}
    monkeypatch.setattr(op3_repeats, "PLACES", 1024)
    assert all((op3_repeats.smallest(hashes, reach) == places).all() for reach, places in whole.items())


def test_very_long_text(spark):
    rng = random.Random(11)
    long = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(300_000))
    text = long + "#" + long[50_000:50_450]
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in op3_repeats.repeated_strings(df).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (len(text), 900, 2) and got[2].n_removed == 0
