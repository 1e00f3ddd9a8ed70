"""The suspicion score, flags, exports and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorlake.functions.exprs import clip01, holds, share
from candorlake.functions.quantiles import exact_quantiles

#: Weights of the components; they add up to one. Added in this order, which is the SQL's: another one
#: changes the last bit, and a few of some million rounded scores.
WEIGHTS = {
    "network_score": 0.35,
    "burst_suspicion_score": 0.15,
    "rating_deviation_score": 0.10,
    "consistency_score": 0.08,
    "mnr_score": 0.07,
    "pr_score": 0.05,
    "detail_level_score": 0.05,
    "mcs_score": 0.06,
    "fact_compatibility_score": 0.03,
    "attr_template_score": 0.02,
    "sentiment_star_inconsistency": 0.02,
    "sentiment_subrating_inconsistency": 0.02,
}
HIGH, VERY_HIGH = 0.90, 0.95
#: Scores are compared with quantiles at this many decimals, so that the last bit doesn't decide.
DECIMALS = 9
TIERS = ("Low", "Moderate", "Elevated", "Highly Suspicious")


def combined(df: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """The rows with the score tables joined by review_id."""
    for part in parts:
        df = df.join(part, "review_id", "left")
    return df


def suspicion(columns: Sequence[str]) -> Column:
    """The weighted sum; absent and null components count as 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items() if c in columns), F.lit(0.0))
    return F.round(clip01(total), DECIMALS)


def thresholds(scored: DataFrame, levels: Sequence[float] = (HIGH, VERY_HIGH), score: str = "suspicion_score") -> DataFrame:
    """One row with the score's quantiles."""
    return exact_quantiles(scored, score, levels)


def flagged(scored: DataFrame, level: float = HIGH, inclusive: bool = False) -> DataFrame:
    """Adds is_suspicious: above the quantile (or from it on)."""
    name = f"p{round(100 * level)}"
    rows = scored.crossJoin(F.broadcast(thresholds(scored, [level])))
    over = F.col("suspicion_score") >= F.col(name) if inclusive else F.col("suspicion_score") > F.col(name)
    return rows.withColumn("is_suspicious", holds(over)).drop(name)


def tiers(scored: DataFrame) -> DataFrame:
    """Adds tier, by the quantiles 50, 75 and 90; each takes its upper edge."""
    rows = scored.crossJoin(F.broadcast(thresholds(scored, [0.5, 0.75, 0.9])))
    s = F.col("suspicion_score")
    return rows.withColumn("tier", F.when(s <= F.col("p50"), TIERS[0]).when(s <= F.col("p75"), TIERS[1]).when(s <= F.col("p90"), TIERS[2]).when(s.isNotNull(), TIERS[3])).drop("p50", "p75", "p90")


def top(scored: DataFrame, count: int = 50) -> DataFrame:
    return scored.orderBy(F.desc("suspicion_score"), "review_id").limit(count)


def place_summary(scored: DataFrame) -> DataFrame:
    """Reviews, mean score, shares flagged and in bursts of each place, highest mean first."""
    rows = flagged(scored)
    flags = [share(holds(F.col(c))).alias(name) if c in rows.columns else F.lit(0.0).alias(name) for c, name in (("in_burst", "pct_in_burst"), ("in_co_burst", "pct_in_co_burst"))]
    by_place = rows.groupBy("place_name", "place_url").agg(F.count("*").alias("n_reviews"), F.avg("suspicion_score").alias("mean_score"), share(F.col("is_suspicious")).alias("pct_suspicious"), *flags)
    return by_place.orderBy(F.desc("mean_score"), "place_url")


def anonymised(df: DataFrame, salt: str) -> DataFrame:
    """Pseudonyms for reviewers by a salted hash; addresses of profiles and pictures removed."""
    changes = {}
    if "reviewer_user_id" in df.columns:
        uid = F.concat(F.lit("uid_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("reviewer_user_id").cast("string")), 256), 1, 16))
        changes["reviewer_user_id"] = F.when(F.col("reviewer_user_id").isNotNull(), uid)
        if "reviewer_name" in df.columns:
            changes["reviewer_name"] = F.when(F.col("reviewer_user_id").isNotNull(), F.concat(F.lit("reviewer_"), F.substring(F.element_at(F.split(uid, "_"), -1), 1, 10)))
    changes |= {c: F.lit(None).cast(df.schema[c].dataType) for c in ("reviewer_profile_url", "reviewer_avatar_url") if c in df.columns}
    return df.withColumns(changes)


def bridged(raw: DataFrame, hidden: DataFrame) -> DataFrame:
    """(review_id, pseudonym, reviewer_user_id): from the pseudonyms of an export back to the raw ids, by review."""
    return hidden.select("review_id", F.col("reviewer_user_id").alias("pseudonym")).join(raw.select("review_id", "reviewer_user_id"), "review_id")


def reviewer_means(scored: DataFrame) -> DataFrame:
    """(reviewer_user_id, mean_score, n) of scored reviews."""
    return scored.groupBy("reviewer_user_id").agg(F.avg("suspicion_score").alias("mean_score"), F.count("*").alias("n"))


#: Groups of components that the analysis looks at, other than the weights' order.
COMPOSITES = {
    "heuristic": ("mnr_score", "pr_score", "detail_level_score", "reviewer_profile_score", "fact_compatibility_score", "attr_template_score"),
    "temporal": ("burst_suspicion_score", "rating_deviation_score"),
    "network": ("network_score",),
    "semantic": ("mcs_score", "consistency_score", "sentiment_star_inconsistency", "sentiment_subrating_inconsistency"),
}


def composites(df: DataFrame) -> DataFrame:
    """Adds the mean of each group's components that are there."""
    from candorlake.functions.exprs import row_mean

    have = {k: [c for c in v if c in df.columns] for k, v in COMPOSITES.items()}
    return df.withColumns({f"composite_{k}": row_mean(v) for k, v in have.items() if v})
