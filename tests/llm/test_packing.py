import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict

from corpuscle.llm import op4_packing as packing


def one_by_one(lengths, capacities, overhead):
    """Each piece by itself, longest first, into the bin of least room; bins of the plan's choice of size."""
    plan = packing.Plan({}, capacities, overhead)
    lengths = sorted(lengths, reverse=True)
    counts, rooms, fills = Counter(lengths), [], []
    rest = sum(lengths)
    left = 0
    for k, n in enumerate(lengths):
        if not k or n != lengths[k - 1]:
            rest -= n * counts[n]
            left, size = counts[n], None
        at = bisect_left(rooms, (n, -1))
        if at == len(rooms):
            size = size or plan.best_capacity(n, left, rest)
            fills.append(0)
            room, b = size, len(fills) - 1
        else:
            room, b = rooms.pop(at)
        fills[b] += n
        insort(rooms, (room - n, b))
        left -= 1
    return Counter(fills)


def test_plan_is_best_fit():
    for seed in range(6):
        rng = random.Random(seed)
        lengths = [min(100, 1 + int(rng.expovariate(0.06))) for _ in range(400)]
        plan = packing.Plan(dict(Counter(lengths)), (25, 50, 100), 5)
        got = Counter()
        for _, bins, capacity, filled in plan.groups:
            got[filled] += bins
            assert capacity == min(c for c in (25, 50, 100) if c >= filled)
        assert got == one_by_one(lengths, (25, 50, 100), 5)


def test_bins_hold_every_token(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 7)
    rng = random.Random(7)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 9, 20, 33, 64, 65, 200, 1000]))) for i in range(300)] + [(None, "a b"), (5, "a b c"), (5, "a b c"), (9, None)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, bin int, rank int")
    rows = packing.pack_documents(df, (16, 32, 64), 4).collect()
    assert Counter({(d, sum(1 for _ in (t or "").split())) for d, t in docs}).keys()
    assert sum(r.n_tokens for r in rows) == sum(len((t or "").split()) for _, t in docs)
    fill, size, seen = defaultdict(int), {}, set()
    for r in rows:
        if r.n_tokens == 0:
            assert r.bin is None and r.capacity is None
            continue
        fill[r.bin] += r.n_tokens
        assert size.setdefault(r.bin, r.capacity) == r.capacity
        assert (r.bin, r.n_tokens, r.slot) not in seen
        seen.add((r.bin, r.n_tokens, r.slot))
    assert all(size[b] == min(c for c in (16, 32, 64) if c >= n) for b, n in fill.items())
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_choice_of_capacity():
    """Against bins filled one by one: the size of least cost for each token that can fill it."""
    for seed in range(40):
        rng = random.Random(seed)
        capacities, overhead = (16, 32, 64), rng.randint(0, 12)
        length, left, rest = rng.randint(1, 64), rng.randint(1, 9), rng.randint(0, 300)
        costs = {}
        for c in (c for c in capacities if c >= length):
            bins, pieces = [], left
            each = 0
            while (each + 1) * length <= c and each < left:
                each += 1
            while pieces > 0:
                bins.append(min(each, pieces))
                pieces -= each
            costs[c] = (c + overhead) / (each * length + min(c - each * length, rest / len(bins)))
        least = min(costs.values())
        assert packing.Plan({}, capacities, overhead).best_capacity(length, left, rest) == min(c for c, x in costs.items() if abs(x - least) < 1e-12)


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 1_000_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert sum(r.n_tokens for r in rows) == 1_000_001 and len({r.bin for r in rows}) == 245


def test_many_empty_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 1000)
    docs = spark.range(100_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, NULL, '') AS text").unionByName(spark.range(20_000).selectExpr("7L AS doc_id", "'a b c' AS text"))
    out = packing.pack_documents(docs)
    assert out.where("n_tokens = 0 AND bin IS NULL AND slot IS NULL AND capacity IS NULL").count() == 100_000
    bins = out.where("n_tokens > 0").groupBy("bin", "capacity").agg({"n_tokens": "sum", "slot": "count"}).collect()
    assert sum(r["sum(n_tokens)"] for r in bins) == 60_000 and all(r["sum(n_tokens)"] <= r.capacity for r in bins)
    assert out.where("n_tokens > 0").select("bin", "slot").distinct().count() == 20_000
