import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corpuscle.operators import blocks, communities, graph, reach, semantic
from corpuscle.operators.kept import kept
from corpuscle.plans import registry


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, weight long").repartition(5)


def components_by_walk(rows):
    nodes = {x for a, b, _ in rows for x in (a, b)}
    ahead = {n: {b for a, b, _ in rows if a == n} for n in nodes}

    def reached(n):
        seen, todo = set(), [n]
        while todo:
            for m in ahead[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    far = {n: reached(n) for n in nodes}
    return {n: max([n, *(m for m in far[n] if n in far[m])]) for n in nodes}, ahead


def test_strong_components_and_depth(spark):
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(24)]
    rows = [(rng.choice(names), rng.choice(names), rng.randint(0, 2)) for _ in range(30)]
    rows = [r for r in rows if r[0] != r[1] or rng.random() < 0.5] + [("a", "b", 1), ("b", "c", 2), ("d", "c", 0), ("s", "s", 3)]
    of, _ = components_by_walk(rows)
    got = {r.node: r.component for r in reach.strong_components(edges_of(spark, rows), kept).collect()}
    assert got == of and len(set(of.values())) < len(of)
    own = {n: i % 3 for i, n in enumerate(sorted(of)) if i % 2}

    def depth(c, seen=()):
        members = [n for n in of if of[n] == c]
        inner = [w for a, b, w in rows if of[a] == of[b] == c]
        best = max([own.get(n, 0) for n in members] + [w + depth(of[b]) for a, b, w in rows if of[a] == c != of[b]])
        return best + max(inner, default=0)

    want = {n: (depth(of[n]), any(of[a] == of[b] == of[n] for a, b, _ in rows)) for n in of}
    weights = spark.createDataFrame(list(own.items()), "node string, weight long")
    assert {r.node: (r.depth, r.recursive) for r in reach.weighted_depth(edges_of(spark, rows), weights, kept).collect()} == want
    assert reach.strong_components(edges_of(spark, rows).limit(0), kept).count() == 0


def test_sketched_reach_within_its_bound(spark):
    rng = random.Random(8)
    rows = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}", 1) for _ in range(1500)]
    edges = edges_of(spark, rows)
    exact = {r.node: r.reach for r in graph.two_hop(edges).collect()}
    about = {r.node: r.reach for r in reach.sketched_reach(edges, 2, kept).collect()}
    assert exact.keys() == about.keys()
    assert all(abs(about[n] - exact[n]) <= max(1, reach.error_bound() * exact[n]) for n in exact)


def test_reach_in_blocks_is_whole(spark, monkeypatch):
    """Parted in many blocks, chunks and slices, with a hub, copies of edges and loops."""
    for name, most in (("BLOCK", 300), ("CHUNK", 500), ("PAIRS", 64), ("MARKS", 512), ("SLOTS", 4096)):
        monkeypatch.setattr(blocks, name, most)
    rng = random.Random(9)
    rows = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}", 1) for _ in range(1200)] + [("hub", f"n{k}", 1) for k in range(0, 400, 2)] + [("n1", "hub", 1), ("n1", "hub", 2), ("s", "s", 1), ("a", "b", 1)]
    edges = edges_of(spark, rows)
    ahead = {}
    for a, b, _ in rows:
        ahead.setdefault(a, set()).add(b)

    def within(n, hops):
        return set() if not hops else ahead.get(n, set()) | {x for m in ahead.get(n, ()) for x in within(m, hops - 1)}

    got = {r.node: r.reach for r in reach.counted_reach(edges, kept).collect()}
    assert got == {n: len(within(n, 2)) for n in ahead} == {r.node: r.reach for r in graph.two_hop(edges).collect()}
    for hops in (1, 3):
        about = {r.node: r.reach for r in reach.sketched_reach(edges, hops, kept).collect()}
        assert about.keys() == ahead.keys()
        assert all(abs(about[n] - len(within(n, hops))) <= max(1, reach.error_bound() * len(within(n, hops))) for n in ahead)
    assert reach.counted_reach(edges.limit(0), kept).count() == 0 == reach.sketched_reach(edges.limit(0), 2, kept).count()


def test_reach_through_one_node(spark):
    """A star through one node has the square of its ends as pairs."""
    n = 400
    rows = [(f"a{k}", "mid", 1) for k in range(n)] + [("mid", f"b{k}", 1) for k in range(n)]
    step, _ = blocks.numbered(edges_of(spark, rows), kept)
    out = kept(reach.counted(step, blocks.in_blocks(step, 2 * n, kept), 2 * n))
    assert sorted(r.reach for r in out.collect()) == [n] + [n + 1] * n


def modularity(rows, label):
    total = 2 * sum(w for *_, w in rows)
    inner, degree = {}, {}
    for a, b, w in rows:
        for x, y in ((a, b), (b, a)):
            degree[label[x]] = degree.get(label[x], 0) + w
            if label[x] == label[y]:
                inner[label[x]] = inner.get(label[x], 0) + w
    return sum(inner.get(c, 0) / total - (degree[c] / total) ** 2 for c in degree)


def test_louvain(spark):
    rng = random.Random(6)
    rows = {}
    for block in range(5):
        for _ in range(70):
            a, b = rng.randrange(14), rng.randrange(14)
            rows[f"{block}-{a:02d}", f"{block}-{b:02d}"] = rng.randint(1, 3)
    for _ in range(40):
        rows[f"{rng.randrange(5)}-{rng.randrange(14):02d}", f"{rng.randrange(5)}-{rng.randrange(14):02d}"] = 1
    rows = [(a, b, w) for (a, b), w in rows.items()]
    edges = edges_of(spark, rows)
    labels = {r.node: r.cluster for r in communities.louvain(edges, kept).collect()}
    assert labels == {r.node: r.cluster for r in communities.louvain(edges.repartition(3), kept).collect()}
    votes = {r.node: r.cluster for r in graph.clusters(edges, keep=kept).collect()}
    mine = modularity(rows, labels)
    assert mine >= modularity(rows, votes) - 1e-9 and mine > 0.5
    links = communities.symmetric(edges)
    assert abs(communities.modularity(links, spark.createDataFrame(list(labels.items()), "node string, cluster string")) - mine) < 1e-9
    pure = [{v.split("-")[0] for n, v in labels.items() if labels[n] == c for v in [n]} for c in set(labels.values())]
    assert all(len(p) == 1 for p in pure) and 5 <= len(pure) <= 7
    assert communities.louvain(edges.limit(0), kept).count() == 0


def test_semantic_lists(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple tart"), (3, "car engine oil"), (4, ""), (5, None), (6, "apple apple apple")], "id long, text string")
    lists = semantic.semantic_lists(docs, F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: t != ""), kept)
    assert lists.documents == 4
    got = {r.id: r.score for r in lists.search(["apple", "pie"], 0.1).collect()}
    assert set(got) == {1, 2, 6} and got[1] > got[6] > got[2]
    assert {r.id: round(r.score, 9) for r in lists.search(["apple"], 0.5).collect()} == {6: 1.0} and lists.search(["zebra"]).count() == 0


def test_sources_of_the_same_targets_are_one(spark):
    rows = [(f"a{i}", f"b{j}", 1) for i in range(6) for j in range(5)] + [(f"b{j}", f"a{i}", 1) for i in range(6) for j in range(5)]
    step, _ = blocks.numbered(edges_of(spark, rows), kept)
    of, one, onward = blocks.folded(step, kept)
    assert of.count() == 11 and one.count() == 11 and onward.distinct().count() == 4
    assert sorted(r.reach for r in reach.counted_reach(edges_of(spark, rows), kept).collect()) == [11] * 11


def test_a_chunk_keeps_members_only_of_small_unions():
    """Else every union is made member by member in chunks of at most as many slots as are kept."""
    slots = np.arange(64, dtype=np.uint64)
    values = (slots << np.uint64(52) | np.uint64(1)).view(np.int64)
    filled, _, counts = blocks.registers(64, 52, 512, True)(np.array([0, 1]), np.array([0, 1]), np.array([0, 60, 64]), values, 2)
    assert filled.to_pylist() == [60, 4] and counts.to_pylist() == [513, 4]


def test_reach_without_keys(spark, tmp_path):
    """A missing key is a node, but nothing follows from it; copies of rows change nothing."""
    tables = {
        "orders": "SELECT * FROM (VALUES (1, 1), (2, NULL), (3, 2), (3, 2)) t(o_orderkey, o_custkey)",
        "lineitem": "SELECT * FROM (VALUES (1, NULL), (1, 49), (2, 48), (2, 47), (3, 47), (3, 46)) t(l_orderkey, l_suppkey)",
        "supplier": "SELECT * FROM (VALUES (49, 0), (49, 1), (48, 0), (47, 1), (NULL, 1)) t(s_suppkey, s_nationkey)",
        "customer": "SELECT * FROM (VALUES (1, 0), (1, 1), (2, 0), (3, 1), (3, 1), (NULL, 0)) t(c_custkey, c_nationkey)",
    }
    duck = duckdb.connect()
    for name, rows in tables.items():
        duck.execute(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet'")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = duck.execute(registry.oracle_sql()["sketched_reach"]).fetchall()
    got = [tuple(r) for r in registry.queries()["sketched_reach"](spark, str(tmp_path)).select("node", "reach", "within").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[0] is None for r in want)
