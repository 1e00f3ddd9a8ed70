"""What queries move: rows of reviews stay where they are when they meet few rows, and meet no texts."""

from candorlake.operators import network, prepare, semantic, temporal
from candorlake.plans import catalog
from candorlake.sources.tables import reviews, table

FOLDER = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_come_last(spark):
    """Lines meet suppliers and parts before they carry columns of orders and customers; suppliers are sent."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planned(reviews(spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 3


def test_burst_days_are_sent(spark):
    rows = catalog.written(reviews(spark, FOLDER))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planned(temporal.in_bursts(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_calendar_joins_nothing(spark):
    days = temporal.daily(reviews(spark, FOLDER).limit(100))
    plan = temporal.calendar(spark.createDataFrame(days.collect(), days.schema))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_addresses_of_places_are_sent(spark):
    rows = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("a", "u2"), (None, "u3")], "place_id string, place_url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = prepare.with_canonical_urls(rows)
        assert "SortMergeJoin" not in planned(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.place_url for r in got.collect()) == ["u2", "u2", "u2", "u3"]


def test_texts_stay_with_documents(spark):
    rows = reviews(spark, FOLDER)
    got = catalog._with_texts(spark, FOLDER, rows)
    assert "review_text" not in got.columns and "embedding" not in got.columns
    text = table(spark, FOLDER, "documents").select("text", semantic.keyword_hits("text", catalog._SCORE_RULES).alias("hits"))
    assert all(r.hits == [any(w in r.text.lower() for w in rule.keywords) for rule in catalog._SCORE_RULES] for r in text.collect())


def test_places_of_few_visitors_send_numbers(spark, monkeypatch):
    """Whole lists of places are compared at hot places only; here there are none."""
    monkeypatch.setattr(network, "_by_lists", None)
    rows = [(u, p) for u in ("u1", "u2", "u3") for p in ("p1", "p2", "p3", f"own{u}")] + [("u4", p) for p in ("p1", "p2", "x")]
    got = {r.reviewer_user_id: r.co_reviewer_count for r in network.co_reviewers(spark.createDataFrame(rows, "reviewer_user_id string, place_id string")).collect()}
    assert got == {"u1": 2, "u2": 2, "u3": 2}


def test_co_reviewers_of_both_kinds_of_places(spark, monkeypatch):
    """Pairs with none to three hot places and some others in common, as by brute force; task boundaries anywhere."""
    import random

    monkeypatch.setattr(network, "BLOCK", 4)
    r = random.Random(9)
    visits = {f"u{i}": set(r.sample([f"h{j}" for j in range(4)], r.randint(0, 3))) | set(r.sample([f"p{j}" for j in range(50)], r.randint(0, 6))) for i in range(120)}
    rows = [(u, p) for u, v in visits.items() for p in v for _ in range(r.randint(1, 2))]
    got = {x.reviewer_user_id: x.co_reviewer_count for x in network.co_reviewers(spark.createDataFrame(rows, "reviewer_user_id string, place_id string")).collect()}
    want = {u: sum(len(visits[u] & visits[o]) >= 3 for o in visits if o != u) for u in visits}
    assert got == {u: n for u, n in want.items() if n}
