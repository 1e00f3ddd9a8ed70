"""Every registered query against DuckDB on the same tables."""

import pytest

from candorlake.plans import catalog
from parity import connect, differences

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLES[name], con) == []


def test_pagerank_adds_up_and_has_converged(spark):
    from candorlake.operators import graph, network
    from candorlake.sources.tables import reviews

    edge = network.edges(reviews(spark, "/root/testdata/sf0.001"))
    a = {r.node: r.rank for r in graph.pagerank(edge, 1e-12).collect()}
    b = {r.node: r.rank for r in graph.pagerank(edge).collect()}
    assert abs(sum(a.values()) - 1) < 1e-9
    assert sum(abs(a[k] - b[k]) for k in a) < 1e-6 * len(a)


def test_sample_keeps_strata(spark):
    rows = catalog.stratified_sample(spark, "/root/testdata/sf0.01").collect()
    again = catalog.stratified_sample(spark, "/root/testdata/sf0.01").collect()
    assert {r.review_language for r in rows} == {"en", "de", "unknown"} and sorted(rows) == sorted(again) and len(rows) == 9000


def test_sample_against_brute_force(spark):
    from collections import Counter

    from candorlake.operators import sampling
    from pyspark.sql import functions as F

    rows = [(i, "big" if i % 10 else None if i % 20 else "mid") for i in range(3000)] + [(10_000 + i, f"tiny{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, s string")
    hashed = {r.id: r.h for r in df.select("id", F.xxhash64(F.col("id"), F.lit(sampling.SEED)).alias("h")).collect()}
    sizes = Counter(s for _, s in rows)
    for target in (300, 40):
        quota = {s: min(n, max(20, round(n / len(rows) * target))) for s, n in sizes.items()}
        best = {s: sorted((i for i, t in rows if t == s), key=lambda i: (hashed[i], i))[: quota[s]] for s in sizes}
        first = {v[0] for v in best.values()}
        want = {i for v in best.values() for i in v}
        if len(want) > target:
            want = first | set(sorted(want - first, key=lambda i: (hashed[i], i))[: target - len(first)])
        assert {r.id for r in sampling.stratified(df, "s", "id", target).collect()} == want


def test_dbscan_of_two_heaps(spark):
    from candorlake.operators.cluster import dbscan

    rows = [(i, (i % 5) * 0.1, 0.0) for i in range(5)] + [(10 + i, 5 + i * 0.1, 5.0) for i in range(6)] + [(99, 50.0, 50.0)]
    found = {r.id: r.cluster for r in dbscan(spark.createDataFrame(rows, "id long, x0 double, x1 double"), "id").collect()}
    assert {found[i] for i in range(5)} == {0} and {found[10 + i] for i in range(6)} == {10} and found[99] == -1


def test_dbscan_against_brute_force(spark, monkeypatch):
    import random

    from candorlake.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 7)
    r = random.Random(3)
    points = [(i, *(c + r.gauss(0, 0.35) for c in r.choice([(0, 0), (2, 1), (2.8, 1.2), (9, 9)]))) if r.random() < 0.9 else (i, r.uniform(-3, 12), r.uniform(-3, 12)) for i in range(300)]
    eps, least = 0.4, 5
    near = {i: [j for j, *q in points if sum((a - b) ** 2 for a, b in zip(p, q)) <= eps * eps] for i, *p in points}
    core = {i for i in near if len(near[i]) >= least}
    want = dict.fromkeys(near, -1)
    for i in sorted(core):
        if want[i] == -1:
            todo = [i]
            while todo:
                j = todo.pop()
                if want[j] == -1:
                    want[j] = i
                    todo += [k for k in near[j] if k in core]
    for i in near:
        if i not in core and (via := [j for j in near[i] if j in core]):
            want[i] = want[min(via)]
    got = {x.id: x.cluster for x in cluster.dbscan(spark.createDataFrame(points, "id long, x0 double, x1 double"), "id", eps, least).collect()}
    assert got == want and len(set(want.values())) > 3
