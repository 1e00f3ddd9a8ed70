"""Components of the whole reviewer-place graph against a union of sets."""

from collections import Counter

from candorlake.operators import graph, network
from candorlake.plans import catalog
from candorlake.sources.tables import reviews

FOLDER = "/root/testdata/sf0.01"


def by_hand(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return Counter(find(x) for x in root)


def test_every_review_is_in_a_component(spark):
    edges = [(r.src, r.dst) for r in network.edges(reviews(spark, FOLDER)).collect()]
    got = {r.component: r["size"] for r in catalog.review_component_sizes(spark, FOLDER).collect()}
    assert got == by_hand(edges) and sum(got.values()) == len({x for e in edges for x in e})


def test_chains_loops_and_repeats(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y"), ("y", "x"), ("x", "y"), ("z", "z"), ("y", "w")]
    got = {r.component: r["size"] for r in graph.component_sizes(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == by_hand(edges) == {"n00": 21, "w": 3, "z": 1}
