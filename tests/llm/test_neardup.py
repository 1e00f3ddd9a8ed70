"""Near duplicates: equal to SQL on the documents and to brute force on made groups, whatever the block size."""

import random

import pytest

from candorlake.llm import neardup, oracles
from candorlake.operators.graph import rooted
from parity import connect, differences

FOLDER = "/root/testdata/sf0.01"


def brute(rows, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(df, percent=85):
    rows = neardup.near_duplicates(df, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("block", [3, 256])
def test_same_as_sql(spark, docs, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    assert differences(neardup.near_duplicates(docs), oracles.NEAR_DUPLICATES, connect(FOLDER)) == []


@pytest.mark.parametrize(("block", "percent"), [(4, 85), (64, 80)])
def test_groups_of_copies(spark, block, percent, monkeypatch):
    """A large group whose members differ by different amounts: chains, outliers, exact copies, and others
    that share a long passage only."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(8)
    word = lambda: f"v{r.randrange(3000)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
            t[r.randrange(120)] = word()
        rows.append((i * 7 % 1000, " ".join(t)))
    passage = " ".join(word() for _ in range(60))
    rows += [(2000 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(60)]
    rows += [(4000 + i, "a few words") for i in range(5)] + [(5000, "a few"), (None, rows[0][1]), (6000, None), (6001, "")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent) == brute(rows, percent)


def test_nodes_that_reach_no_other_component(spark):
    """Only sets with enough shingles of other components are compared further; repeats in the own one don't count."""
    import numpy as np

    common = list(range(70))
    sets = {i: common + list(range(1000 * i, 1000 * i + 30)) for i in range(1, 6)}  # a common passage of 70 %
    sets |= {6: sets[5], 7: common + list(range(9000, 9015)), 8: common + list(range(9000, 9014))}  # 6 is 5's copy
    comp = {6: 5}
    rows = [(i, comp.get(i, i), np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()]
    rows += [(9, 9, np.array([2**64 - 1], np.uint64).tobytes()), (10, 10, rows[0][2])]
    placed = spark.createDataFrame([(t, n, c) for t in (1, 2) for n, c, _ in rows], "token long, node long, comp long")
    traits = spark.createDataFrame([(n, s) for n, _, s in rows], "node long, shingles binary")
    able = lambda percent: sorted(r.node for r in neardup._across(placed, traits, percent).collect())
    assert able(85) == [1, 7, 8, 10]
    assert able(70) == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert able(100) == [1, 8, 10]


@pytest.mark.parametrize("percent", [80, 85])
def test_common_passage(spark, percent, monkeypatch):
    """Lists far larger than a block: pairs of copies and single texts around one passage, and passages that make
    up nearly a whole text; the same groups as brute force, by the broadcast and by the shuffle."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BROADCAST_NODES", 0 if percent == 80 else 1000)
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(140)]
    texts = []
    for i in range(120):
        own = [word() for _ in range(r.choice([5, 15, 20, 25, 40, 60, 60]))]
        texts.append(passage + own)
        if i % 3 == 0:
            twin = passage + own
            twin[r.randrange(len(twin))] = word()
            texts.append(twin)
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent) == brute(rows, percent)


@pytest.mark.parametrize("nodes", [0, 1000])
def test_one_id_for_many_texts(spark, nodes, monkeypatch):
    """Each node is looked up by one row of its own: rows without an id, or with one id, don't meet each other."""
    monkeypatch.setattr(neardup, "BROADCAST_NODES", nodes)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield from plain(iter([batch]))

    plain = neardup._sets
    monkeypatch.setattr(neardup, "_sets", counted)
    r = random.Random(12)
    rows = []
    for i in range(150):
        t = [f"u{r.randrange(5000)}" for _ in range(60)]
        rows += [(None if i % 2 else 3, " ".join(t)), (None if i % 3 else 4, " ".join(t[:-1] + ["other"]))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows, 85)
    assert 300 <= seen.value < 400


def broadcasts(df):
    """(columns, operators) of each broadcast in the plan that a frame starts with."""

    def below(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from below(plan.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    for node in below(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan):
        if node.nodeName() == "BroadcastExchange":
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            yield set(names), {x.nodeName() for x in below(node)}


def pairs_of_copies():
    r = random.Random(21)
    rows = []
    for i in range(40):
        t = [f"u{r.randrange(5000)}" for _ in range(60)]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(t[:-1] + ["other"]))]
    return rows


def seen_broadcasts(spark, monkeypatch):
    """Gets the broadcasts of each table that is stored from now on; Spark's own threshold holds."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    seen, plain = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df: (seen.extend(broadcasts(df)), plain(df))[1])
    return seen


def assert_sizes_are_known(seen):
    for names, operators in seen:
        assert names.isdisjoint({"signature", "x", "y", "shingles", "prefix", "value", "shingle", "df"}), names
        assert operators.isdisjoint({"Generate", "MapInArrow"}), operators


@pytest.mark.parametrize("nodes", [0, 1000])
def test_nothing_of_unknown_size_is_broadcast(spark, nodes, monkeypatch):
    """Exploded signatures and sets, arrays and blobs look small to Spark: none goes through the driver, although all
    these tables are below its threshold."""
    monkeypatch.setattr(neardup, "BROADCAST_NODES", nodes)
    seen = seen_broadcasts(spark, monkeypatch)
    rows = pairs_of_copies()
    kept = neardup.without_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows, 80)})
    assert any(names == {"node", "row_key"} for names, _ in seen) == (nodes > 0)
    assert_sizes_are_known(seen)


def test_groups_are_not_broadcast(spark, monkeypatch):
    """The same for the groups of all rows, which the result is made of."""
    seen = seen_broadcasts(spark, monkeypatch)
    rows = pairs_of_copies()
    result = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert_sizes_are_known(seen)
    assert [names for names, _ in broadcasts(result) if "root" in names] == []
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in result.collect()), key=str) == brute(rows, 85)


def test_odd(spark, odd, empty):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()], 85)
    assert found(empty) == []


def test_least_matches_is_rarely_missed():
    import math

    for percent in (80, 85, 95):
        t, n, p = neardup.least_matches(percent), neardup.COORDINATES, percent / 100
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(t)) < 1e-5


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4999), (4999, 5000), (7, 7)]
    got = {r.node: r.root for r in rooted(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and got[5000] == 4999
    assert rooted(spark.createDataFrame([], "a long, b long")).collect() == []
