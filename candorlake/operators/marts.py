"""The star schema: staging views and mart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorlake.operators.prepare import latest

REVIEWER = ("reviewer_user_id", "reviewer_name", "reviewer_review_count", "reviewer_photo_count", "reviewer_photo_review_ratio", "reviewer_is_local_guide", "reviewer_level", "reviewer_badge", "reviewer_avatar_url", "reviewer_profile_url")
PLACE = ("place_url", "place_name", "place_overall_rating", "place_total_reviews")
_RESPONSE = ("owner_response_text", "owner_response_timestamp_iso", "owner_response_language")
_CONTEXT = ("attr_meal_type", "attr_price_range", "attr_noise_level", "attr_service_type", "attr_wait_time", "attr_group_size", "attr_parking", "attr_vegetarian", "review_source", "review_source_rating", "crawl_timestamp")
_SUBS = ("sub_rating_food", "sub_rating_service", "sub_rating_atmosphere")
#: Columns of the fact table by the group that they describe.
FACT = (
    "review_id", "restaurant_id", "reviewer_user_id",
    "review_text", "review_text_length", "rating_stars", "review_language", *_SUBS, "review_detail_level",
    "has_review_text", "has_sub_ratings", "has_owner_response", "was_edited", "edit_delta_hours",
    "review_images_count", "review_date", "review_created_at", "review_edited_at",
    *PLACE[1:], *REVIEWER[1:8], *_RESPONSE, *_CONTEXT,
)


def staged_reviews(clean: DataFrame) -> DataFrame:
    return (
        clean.filter(F.col("review_id").isNotNull())
        .withColumns({
            "review_date": F.to_date("timestamp_created_iso"),
            "review_text_length": F.length(F.coalesce("review_text", F.lit(""))),
        })
        .withColumnsRenamed({"timestamp_created_iso": "review_created_at", "timestamp_edited_iso": "review_edited_at"})
    )


def staged_reviewers(clean: DataFrame) -> DataFrame:
    rows = clean.filter(F.col("reviewer_user_id").isNotNull())
    return latest(rows, "reviewer_user_id", "crawl_timestamp", "review_id").select(*[c for c in REVIEWER if c in clean.columns])


def staged_places(clean: DataFrame) -> DataFrame:
    rows = clean.filter(F.col("place_url").isNotNull())
    return latest(rows, "place_url", "crawl_timestamp", "review_id").select(*PLACE)


def dim_reviewers(clean: DataFrame) -> DataFrame:
    return staged_reviewers(clean)


def dim_restaurants(clean: DataFrame) -> DataFrame:
    return staged_places(clean).withColumnRenamed("place_url", "restaurant_id")


def fact_reviews(clean: DataFrame) -> DataFrame:
    rows = staged_reviews(clean).withColumnRenamed("place_url", "restaurant_id")
    return rows.select(*[c for c in FACT if c in rows.columns])


def build(clean: DataFrame, save: bool = False) -> dict[str, DataFrame]:
    """All six relations as temporary views; with ``save``, the marts as tables."""
    made = {"stg_reviews": staged_reviews(clean), "stg_reviewers": staged_reviewers(clean), "stg_restaurants": staged_places(clean)}
    marts = {"fact_reviews": fact_reviews(clean), "dim_reviewers": dim_reviewers(clean), "dim_restaurants": dim_restaurants(clean)}
    for name, df in made.items() if save else (made | marts).items():
        df.createOrReplaceTempView(name)
    for name, df in marts.items() if save else ():
        df.write.mode("overwrite").saveAsTable(name)
    return made | marts
