"""Bursts of reviews at a place, and reviewers who take part in bursts at several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candorlake.functions.exprs import clip01, holds, share
from candorlake.session import sent

WINDOW_DAYS, LEAST_DAYS = 14, 3
Z_LIMIT, LEAST_REVIEWS = 2.5, 4
LEAST_FILL, HOMOGENEITY_WEIGHT = 0.2, 0.15
GAP_DAYS, LEAST_SHARED = 3, 2


def daily(df: DataFrame, place: str = "place_id", ts: str = "created_at") -> DataFrame:
    """Reviews, mean stars and shares of each place and day."""
    measures = [F.count("*").alias("review_count"), F.avg("rating_stars").alias("mean_stars"), share(F.col("rating_stars") == 5).alias("pct_five_stars"), share(~F.col("has_review_text")).alias("pct_no_text")]
    if "was_edited" in df.columns:
        measures.append(share(F.col("was_edited")).alias("pct_edited"))
    rows = df.filter(F.col(ts).isNotNull())
    return rows.groupBy(F.col(place).alias("place"), F.to_date(ts).alias("day")).agg(*measures)


def calendar(days: DataFrame) -> DataFrame:
    """All days from a place's first to its last, those without reviews with zeros.

    Each day is followed by the empty ones before the place's next: no join, and the partitioning by place that bursts
    need as well.
    """
    after = F.lead("day").over(Window.partitionBy("place").orderBy("day"))
    every = F.sequence("day", F.coalesce(F.date_sub("after_", 1), "day"), F.expr("INTERVAL 1 DAY"))
    own = F.col("place").isNotNull() & (F.col("each_") == F.col("day"))
    rows = days.withColumn("after_", after).withColumn("each_", F.explode(every))
    return rows.select("place", F.col("each_").alias("day"), *[F.coalesce(F.when(own, F.col(c)), F.lit(0).cast(kind)).alias(c) for c, kind in days.dtypes if c not in ("place", "day")])


def bursts(dense: DataFrame) -> DataFrame:
    """Adds the z-score against the WINDOW_DAYS days before, is_burst and burst_id (0 outside).

    The id counts the quiet days so far, so the days of one burst share it.
    """
    by_day = Window.partitionBy("place").orderBy("day")
    before = by_day.rowsBetween(-WINDOW_DAYS, -1)
    enough = F.count("*").over(before) >= LEAST_DAYS
    rows = dense.withColumns({
        "rolling_mean": F.when(enough, F.avg("review_count").over(before)),
        "rolling_std": F.when(enough, F.stddev_samp("review_count").over(before)),
    })
    rows = rows.withColumn("z_score", F.when(holds(F.col("rolling_std") > 0), (F.col("review_count") - F.col("rolling_mean")) / F.col("rolling_std")).otherwise(0.0))
    rows = rows.withColumn("is_burst", (F.col("z_score") > Z_LIMIT) & (F.col("review_count") >= LEAST_REVIEWS))
    quiet = F.sum(F.when(F.col("is_burst"), 0).otherwise(1)).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("burst_id", F.when(F.col("is_burst"), quiet).otherwise(0))


def burst_days(df: DataFrame, place: str = "place_id", ts: str = "created_at") -> DataFrame:
    return bursts(calendar(daily(df, place, ts)))


def in_bursts(df: DataFrame, place: str = "place_id", ts: str = "created_at") -> DataFrame:
    """Rows of burst days with place, day and burst_id. Burst days are few beside reviews, so these stay where they are."""
    days = sent(burst_days(df, place, ts).filter("is_burst").select("place", "day", "burst_id"))
    return df.withColumns({"place": F.col(place), "day": F.to_date(ts)}).join(days, ["place", "day"])


def burst_windows(inside: DataFrame) -> DataFrame:
    return inside.groupBy("place", "burst_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("burst_reviews"), share(F.col("rating_stars") == 5).alias("burst_five"), share(~F.col("has_review_text")).alias("burst_no_text"))


def burst_quality(df: DataFrame, inside: DataFrame, place: str = "place_id") -> DataFrame:
    """Windows with how far their shares lie above the place's own, over all its reviews."""
    usual = df.groupBy(F.col(place).alias("place")).agg(share(F.col("rating_stars") == 5).alias("usual_five"), share(~F.col("has_review_text")).alias("usual_no_text"))
    rows = burst_windows(inside).join(usual, "place", "left")
    return rows.withColumn("burst_score", 0.6 * clip01(F.col("burst_five") - F.col("usual_five")) + 0.4 * clip01(F.col("burst_no_text") - F.col("usual_no_text")))


def filled_attributes(df: DataFrame, attributes: Sequence[str]) -> list[str]:
    """Those that enough rows have; one aggregate, one row."""
    there = [a for a in attributes if a in df.columns]
    if not there:
        return []
    rates = df.agg(*[F.avg(F.col(a).isNotNull().cast("double")).alias(a) for a in there]).first()
    return [a for a in there if (rates[a] or 0.0) >= LEAST_FILL]


def homogeneity(inside: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Share of the most frequent combination of attributes among a window's rows that have any."""
    some = inside.filter(F.coalesce(*attributes).isNotNull())
    counts = some.groupBy("place", "burst_id", F.struct(*attributes).alias("combination")).agg(F.count("*").alias("n"))
    return counts.groupBy("place", "burst_id").agg((F.max("n") / F.sum("n")).alias("homogeneity"))


def adjusted_windows(df: DataFrame, inside: DataFrame, attributes: Sequence[str], place: str = "place_id") -> DataFrame:
    """Windows with burst_suspicion_score: the score, blended with homogeneity where attributes are filled."""
    windows = burst_quality(df, inside, place)
    usable = filled_attributes(df, attributes)
    if not usable:
        return windows.withColumns({"homogeneity": F.lit(0.0), "burst_suspicion_score": F.col("burst_score")})
    rows = windows.join(homogeneity(inside, usable), ["place", "burst_id"], "left").na.fill(0.0, ["homogeneity"])
    return rows.withColumn("burst_suspicion_score", (1 - HOMOGENEITY_WEIGHT) * F.col("burst_score") + HOMOGENEITY_WEIGHT * F.col("homogeneity"))


def co_burst_links(inside: DataFrame) -> DataFrame:
    """(place_a, burst_a, place_b, burst_b, reviewer): a reviewer in two windows at different places that
    overlap or lie at most GAP_DAYS apart. Joined on the reviewer; the days are a further condition."""
    windows = inside.groupBy("place", "burst_id").agg(F.min("day").alias("low"), F.max("day").alias("high"))
    members = inside.select("place", "burst_id", "reviewer_user_id").distinct().join(windows, ["place", "burst_id"])
    side = lambda x: members.select(F.col("reviewer_user_id").alias("reviewer"), *[F.col(c).alias(f"{c}_{x}") for c in ("place", "burst_id", "low", "high")])
    near = (F.col("low_a") <= F.date_add("high_b", GAP_DAYS)) & (F.col("low_b") <= F.date_add("high_a", GAP_DAYS))
    pairs = side("a").join(side("b"), "reviewer").filter((F.col("place_a") < F.col("place_b")) & near)
    return pairs.select("place_a", F.col("burst_id_a").alias("burst_a"), "place_b", F.col("burst_id_b").alias("burst_b"), "reviewer")


def co_burst_pairs(links: DataFrame) -> DataFrame:
    keys = ["place_a", "burst_a", "place_b", "burst_b"]
    return links.groupBy(*keys).agg(F.count("*").alias("shared_reviewers")).filter(F.col("shared_reviewers") >= LEAST_SHARED)


def co_burst_reviewers(links: DataFrame) -> DataFrame:
    return links.join(co_burst_pairs(links), ["place_a", "burst_a", "place_b", "burst_b"], "left_semi").select(F.col("reviewer").alias("reviewer_user_id")).distinct()


def flags(df: DataFrame, place: str = "place_id", ts: str = "created_at") -> DataFrame:
    """(review_id, in_burst) for each row: of scores, the flag alone."""
    days = sent(burst_days(df, place, ts).filter("is_burst").select("place", "day", F.lit(True).alias("in_burst")))
    rows = df.select("review_id", F.col(place).alias("place"), F.to_date(ts).alias("day")).join(days, ["place", "day"], "left")
    return rows.select("review_id", holds(F.col("in_burst")).alias("in_burst"))


def scores(df: DataFrame, attributes: Sequence[str], place: str = "place_id", ts: str = "created_at", inside: DataFrame | None = None) -> DataFrame:
    """(review_id, in_burst, burst_suspicion_score, burst_attr_homogeneity, in_co_burst) for each row.

    inside: the rows of bursts, where they have been found (and written) before.
    """
    inside = in_bursts(df, place, ts) if inside is None else inside
    windows = adjusted_windows(df, inside, attributes, place).select("place", "burst_id", "burst_suspicion_score", "homogeneity")
    days = sent(inside.select("place", "day", "burst_id").distinct().join(windows, ["place", "burst_id"]))
    flagged = sent(co_burst_reviewers(co_burst_links(inside)).withColumn("in_co_burst", F.lit(True)))
    rows = df.select("review_id", "reviewer_user_id", F.col(place).alias("place"), F.to_date(ts).alias("day")).join(days, ["place", "day"], "left").join(flagged, "reviewer_user_id", "left")
    return rows.select("review_id", F.col("burst_id").isNotNull().alias("in_burst"), F.coalesce("burst_suspicion_score", F.lit(0.0)).alias("burst_suspicion_score"), F.coalesce("homogeneity", F.lit(0.0)).alias("burst_attr_homogeneity"), holds(F.col("in_co_burst")).alias("in_co_burst"))


def summary(df: DataFrame, place: str = "place_id", ts: str = "created_at") -> DataFrame:
    """Days, burst days, windows and the largest z-score of each place."""
    return burst_days(df, place, ts).groupBy("place").agg(F.count("*").alias("n_days"), F.sum("review_count").alias("n_reviews"), F.count_if("is_burst").alias("n_burst_days"), F.round(F.max("z_score"), 6).alias("max_z"))
