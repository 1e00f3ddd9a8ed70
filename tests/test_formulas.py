"""Hand-made cases for each formula."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candorlake.operators import heuristic, marts, network, prepare, quality, reports, sampling, scoring, semantic, temporal

CLOSE = {"abs": 1e-6}


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize(("count", "level", "guide", "photos", "language", "score"), [(1.0, None, False, 0.0, "de", 0.75), (None, 0.0, False, 0.0, "en", 0.975), (15.0, 5.0, True, 15.0, "de", 0.2275), (131.0, 10.0, True, 262.0, None, 0.025)])
def test_profile(spark, count, level, guide, photos, language, score):
    df = spark.createDataFrame([(count, level, guide, photos, language)], "reviewer_review_count double, reviewer_level double, reviewer_is_local_guide boolean, reviewer_photo_count double, review_language string")
    assert one(df.select(heuristic.reviewer_profile().alias("s"))).s == pytest.approx(score, **CLOSE)


@pytest.mark.parametrize(("n", "score"), [(1, 0), (4, 1 / 3), (10, 1), (12, 1)])
def test_most_in_a_day(spark, n, score):
    df = spark.createDataFrame([("u", dt.datetime(2024, 1, 1, h)) for h in range(n)], "reviewer_user_id string, created_at timestamp")
    assert one(heuristic.most_in_a_day(df)).mnr_score == pytest.approx(score, **CLOSE)


@pytest.mark.parametrize(("stars", "score"), [([5, 4], 0.3), ([1, 2], 1.0), ([5, 1], 0.0), ([5, None], 0.0), ([None], 1.0)])
def test_positive_share(spark, stars, score):
    df = spark.createDataFrame([("u", None if s is None else float(s)) for s in stars], "reviewer_user_id string, rating_stars double")
    assert one(heuristic.positive_share(df)).pr_score == score


@pytest.mark.parametrize(("rows", "score"), [([(1, (1, 1, 1))], 0.75), ([(5, (5, 3, 4)), (5, (4, 4, 4))], 0.5), ([(5, (5, None, None)), (5, (5, None, None))], 0.25)])
def test_rating_deviation(spark, rows, score):
    made = [("u", float(s), 4.0, *[None if x is None else float(x) for x in subs]) for s, subs in rows]
    df = spark.createDataFrame(made, "reviewer_user_id string, rating_stars double, place_overall_rating double, sub_rating_food double, sub_rating_service double, sub_rating_atmosphere double")
    assert {round(r.rating_deviation_score, 6) for r in heuristic.rating_deviation(df).collect()} == {score}


@pytest.mark.parametrize(("stars", "subs", "score"), [(5, (1, 2, None), 1), (4, (3, 4, 4), 1 / 6), (4, (None, None, None), 0)])
def test_consistency(spark, stars, subs, score):
    df = spark.createDataFrame([(float(stars), *[None if x is None else float(x) for x in subs])], "rating_stars double, sub_rating_food double, sub_rating_service double, sub_rating_atmosphere double")
    assert one(df.select(heuristic.consistency().alias("s"))).s == pytest.approx(score, **CLOSE)


@pytest.mark.parametrize(("last", "z", "burst"), [(5, 8.672617, 14), (3, 4.818121, 0)])
def test_burst(spark, last, z, burst):
    days = [("p", dt.date(2024, 1, 1) + dt.timedelta(days=i), (i + 1) % 2) for i in range(14)] + [("p", dt.date(2024, 1, 15), last)]
    row = temporal.bursts(spark.createDataFrame(days, "place string, day date, review_count long")).filter("day = '2024-01-15'").first()
    assert row.z_score == pytest.approx(z, **CLOSE) and row.burst_id == burst and row.is_burst == (burst > 0)


def test_no_burst_after_even_days(spark):
    days = [("p", dt.date(2024, 1, 1) + dt.timedelta(days=i), 2) for i in range(14)] + [("p", dt.date(2024, 1, 15), 6)]
    assert temporal.bursts(spark.createDataFrame(days, "place string, day date, review_count long")).filter("is_burst").isEmpty()


def test_co_burst(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("p1", 1, day(d), u) for d in (1, 2) for u in ("u1", "u2", "u3")] + [("p2", 1, day(5), "u2"), ("p2", 1, day(5), "u3"), ("p3", 1, day(9), "u2"), ("p3", 1, day(9), "u3"), ("p4", 1, day(5), "u3")]
    links = temporal.co_burst_links(spark.createDataFrame(rows, "place string, burst_id long, day date, reviewer_user_id string"))
    assert {(r.place_a, r.place_b) for r in temporal.co_burst_pairs(links).collect()} == {("p1", "p2")}
    assert {r.reviewer_user_id for r in temporal.co_burst_reviewers(links).collect()} == {"u2", "u3"}


@pytest.mark.parametrize(("stars", "even"), [((5, 5, 5), 1.0), ((1, 3, 5), 0.591752), ((5, 5, None), 0.0), ((5,), 0.5)])
def test_evenness(spark, stars, even):
    df = spark.createDataFrame([("u", f"p{i}", None if s is None else float(s), False) for i, s in enumerate(stars)], "reviewer_user_id string, place_id string, rating_stars double, in_burst boolean")
    assert one(network.reviewer_metrics(df)).rating_homogeneity == pytest.approx(even, **CLOSE)


def test_network_score(spark):
    metrics = spark.createDataFrame([("a", 3, 3, 1.0, 1.0, 1 / 3), ("b", 6, 6, 0.0, 0.0, 0.0), ("c", 1, 1, 0.5, 0.0, 0.0)], "reviewer_user_id string, degree long, edge_count long, rating_homogeneity double, pct_five_star double, burst_edge_ratio double")
    common = spark.createDataFrame([("a", 10)], "reviewer_user_id string, co_reviewer_count long")
    got = {r.reviewer_user_id: r.network_score for r in network.reviewer_scores(metrics, common, metrics.filter("false").select("reviewer_user_id")).collect()}
    assert got["a"] == pytest.approx(0.533333, **CLOSE) and got["c"] == pytest.approx(0.116667, **CLOSE)


def test_co_reviewers(spark):
    rows = [(u, p) for u in ("u1", "u2") for p in ("p1", "p2", "p3")] + [("u1", "p1"), ("u3", "p1"), ("u3", "p2")]
    got = {r.reviewer_user_id: r.co_reviewer_count for r in network.co_reviewers(spark.createDataFrame(rows, "reviewer_user_id string, place_id string")).collect()}
    assert got == {"u1": 1, "u2": 1}


def test_co_reviewers_of_hot_places(spark, monkeypatch):
    """Three places that everyone has been to, and others: as by brute force, with few pairs looked at."""
    import random

    monkeypatch.setattr(network, "BLOCK", 7)
    r = random.Random(5)
    visits = {f"u{i}": {"h1", "h2", "h3"} - ({f"h{r.randint(1, 3)}"} if r.random() < 0.3 else set()) | {f"p{r.randrange(60)}" for _ in range(r.randint(0, 4))} for i in range(150)}
    visits["x"] = {"p1"}
    rows = [(u, p) for u, v in visits.items() for p in v]
    got = {r.reviewer_user_id: r.co_reviewer_count for r in network.co_reviewers(spark.createDataFrame(rows, "reviewer_user_id string, place_id string")).collect()}
    want = {u: sum(len(visits[u] & visits[o]) >= 3 for o in visits if o != u) for u in visits}
    assert got == {u: n for u, n in want.items() if n}


def test_most_similar(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 1.0]), (3, "a", [-1.0, 0.0]), (4, "b", [1.0, 0.0])]
    got = {r.id: r.mcs_score for r in semantic.most_similar(spark.createDataFrame(rows, "id long, g string, embedding array<float>"), "g", "id").collect()}
    assert [round(got[i], 6) for i in (1, 2, 3, 4)] == [0.707107, 0.707107, 0.0, 0.0]


def test_facts(spark):
    df = spark.createDataFrame([("viel zu laut, aber günstig", "Ruhig", "Über 60 €"), ("günstig, zu laut", "Laut", "Über 60 €"), ("zu laut", None, None), (None, "Ruhig", "Unter 10 €")], "review_text string, attr_noise_level string, attr_price_range string")
    assert [r.s for r in df.select(semantic.fact_compatibility(columns=df.columns).alias("s")).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_sentiment(spark):
    df = spark.createDataFrame([("positive", 1.0), ("negative", 5.0), ("negative", 4.0), ("positive", 2.0), (None, 1.0)], "label string, stars double")
    assert [r.s for r in df.select(semantic.sentiment_mismatch(F.col("label"), F.col("stars")).alias("s")).collect()] == [1, 1, 0, 0, 0]


def test_suspicion(spark):
    assert sum(scoring.WEIGHTS.values()) == pytest.approx(1.0)
    kinds = ", ".join(f"{c} double" for c in scoring.WEIGHTS)
    rows = [tuple(1.0 for _ in scoring.WEIGHTS), tuple(1.0 if c == "network_score" else None for c in scoring.WEIGHTS), tuple(None for _ in scoring.WEIGHTS)]
    df = spark.createDataFrame(rows, kinds)
    assert [r.s for r in df.select(scoring.suspicion(df.columns).alias("s")).collect()] == [1.0, 0.35, 0.0]


def test_thresholds(spark):
    got = lambda values: one(scoring.thresholds(spark.createDataFrame([(float(v),) for v in values], "suspicion_score double"), [0.9])).p90
    assert got(range(11)) == 9.0 and got([1, 2, 3, 4]) == pytest.approx(3.7)


def test_latest(spark):
    rows = [("a", 1), ("a", 3), ("a", None), ("b", None)]
    got = prepare.latest(spark.createDataFrame(rows, "id string, crawl int"), "id", "crawl").collect()
    assert {(r.id, r.crawl) for r in got} == {("a", 3), ("b", None)}


def test_pseudonyms(spark):
    row = one(scoring.anonymised(spark.createDataFrame([("u1", "Ann", "x", "y")], "reviewer_user_id string, reviewer_name string, reviewer_profile_url string, reviewer_avatar_url string"), "change-me"))
    assert tuple(row) == ("uid_10fb9ea445f8859a", "reviewer_10fb9ea445", None, None)


def test_clean(spark):
    titles = ["Bewertungs-ID", "Google Maps URL", "Sterne", "Sprache", "Local Guide", "Reviewer-Fotos", "Reviewer-Bewertungen", "Erstellt am", "Scrapingzeit", "Bewertungstext", "Neu"]
    rows = [
        ("1", "http://x/data=!1s0xAB!2s1", "5", " DE ", "yes", "4", "0", "2024-01-01 00:00:00", "2024-02-01 00:00:00", " \t ", "n"),
        ("1", "http://x/data=!1s0xAB!2s2", "x", "", "no", "4", "2", "bad", "2024-03-01 00:00:00", "good", "n"),
        ("2", "http://x/data=!1s0xAB!2s2", "NA", None, None, None, "2", None, None, None, None),
        (None, "http://x/none", "3", "en", "1", "1", "1", None, None, None, None),
    ]
    got = {r.review_id: r for r in prepare.clean(spark.createDataFrame(rows, ", ".join(f"`{t}` string" for t in titles))).collect()}
    assert set(got) == {"1", "2"}
    a, b = got["1"], got["2"]
    assert (a.place_url, a.rating_stars, a.review_language, a.reviewer_is_local_guide, a.reviewer_photo_review_ratio, a.has_review_text, a.review_detail_level, a.Neu) == ("http://x/data=!1s0xAB!2s2", None, "unknown", False, 2.0, True, 1, "n")
    assert (b.place_id, b.rating_stars, b.review_language, b.reviewer_photo_review_ratio, b.reviewer_level) == ("0xAB", None, "unknown", 0.0, None)


def test_sample_size():
    assert [sampling.target_size(n) for n in (1000, 40_000, 100_000)] == [1000, 6000, 9000]


def test_checks(spark):
    rows = [(str(i % 1200), 4.0 if i else 7.0, "p", None if i == 5 else "u", "t") for i in range(1300)]
    df = spark.createDataFrame(rows, "review_id string, rating_stars double, place_url string, reviewer_user_id string, timestamp_created_iso string")
    report = quality.check(df)
    assert any("1 null" in c for c in report.critical) and any("100 repeats" in c for c in report.critical) and any("1 outside" in c for c in report.critical)
    with pytest.raises(RuntimeError):
        quality.gate(df.drop("place_url"))
    suite = {"expectations": [{"expectation_type": "expect_column_to_exist", "kwargs": {"column": "nope"}}, {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "rating_stars", "min_value": 1, "max_value": 7}}, {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 5}}]}
    assert list(quality.run_suite(df, suite).values()) == [False, True, False]


def test_marts_views(spark):
    titles = ["Bewertungs-ID", "Google Maps URL", "Reviewer-ID", "Scrapingzeit"]
    df = prepare.clean(spark.createDataFrame([("1", "p!1sA!", "u", "2024-01-01 00:00:00"), ("2", "p!1sA!", "u", "2024-01-02 00:00:00")], ", ".join(f"`{t}` string" for t in titles)))
    made = marts.build(df)
    assert made["dim_reviewers"].count() == 1 and made["dim_restaurants"].count() == 1 and len(made["fact_reviews"].columns) == 44
    assert spark.table("fact_reviews").count() == 2 and quality.orphans(made["fact_reviews"], "restaurant_id", made["dim_restaurants"], "restaurant_id").isEmpty()


def test_histogram_edges(spark):
    got = {r.bin: r.n for r in reports.histogram(spark.createDataFrame([(0.0,), (0.019,), (0.02,), (1.0,)], "s double"), "s").collect()}
    assert got == {0: 2, 1: 1, 49: 1}


def test_find_column():
    from candorlake.functions.exprs import find_column

    assert find_column(["a", "place_x"], ["b", "a"]) == "a" and find_column(["a", "place_x"], ["b"], "place") == "place_x" and find_column(["a"]) is None


def test_exact_quantiles(spark):
    import random

    import numpy as np

    r = random.Random(1)
    for values in ([1e12, *(r.random() for _ in range(500))], [r.choice([r.random(), 0.5, 0.25]) for _ in range(700)], [3.0], [2.0, 2.0], [-1e6, 0.0, 1e6]):
        got = one(scoring.exact_quantiles(spark.createDataFrame([(v,) for v in [*values, None]], "s double"), "s", [0.0, 0.05, 0.5, 0.9, 1.0]))
        assert list(got) == pytest.approx(np.quantile(values, [0.0, 0.05, 0.5, 0.9, 1.0]).tolist())
    assert list(one(scoring.exact_quantiles(spark.createDataFrame([], "s double"), "s", [0.5]))) == [None]


def test_near_blocks():
    """Blocks of points as Arrow lists: pairs with two points within reach."""
    import pyarrow as pa
    from candorlake.operators.cluster import _near_blocks

    batch = pa.RecordBatch.from_pydict({"a": [1, 2], "b": [3, 4], "x": [[[0.0, 0.0], [5.0, 5.0]], [[0.0, 0.0]]], "y": [[[5.0, 5.3]], [[9.0, 9.0], [1.0, 0.0]]]})
    (out,) = _near_blocks(0.5, 2)(iter([batch]))
    assert out.to_pydict() == {"a": [1], "b": [3]}
