"""From raw text rows to clean reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candorlake import schema
from candorlake.functions.exprs import has_content, holds, ratio_or_zero, stripped
from candorlake.session import sent


def renamed(raw: DataFrame) -> DataFrame:
    """Known titles to column names; unknown columns stay as they are."""
    return raw.withColumnsRenamed(schema.RAW_NAMES)


def missing_as_null(df: DataFrame) -> DataFrame:
    """Spellings of a missing value in text columns become null."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.col(c).isin(*schema.MISSING_SPELLINGS), F.col(c)) for c in df.columns if kinds[c] == "string"})


def typed(df: DataFrame) -> DataFrame:
    """Numbers, timestamps (UTC) and the guide flag from text; what cannot be read is null, and absent columns
    are added as nulls."""
    absent = [c for c in schema.RAW_NAMES.values() if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("string") for c in absent})
    changes = {c: F.try_to_timestamp(c) for c in schema.TIMESTAMPS}
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    changes |= {c: F.when(~F.isnan(number(c)), number(c)) for c in schema.NUMBERS}
    changes["reviewer_is_local_guide"] = holds(F.col("reviewer_is_local_guide").isin(*schema.TRUE_SPELLINGS))
    return df.withColumns(changes)


def place_id(url) -> F.Column:
    return F.nullif(F.regexp_extract(url, "!1s([^!]+)", 1), F.lit(""))


def derived(df: DataFrame) -> DataFrame:
    df = df.withColumn("place_id", place_id(F.col("place_url")))
    micros = lambda c: F.unix_micros(c)
    df = df.withColumns({
        "edit_delta_hours": (micros("timestamp_edited_iso") - micros("timestamp_created_iso")) / 3.6e9,
        "reviewer_photo_review_ratio": ratio_or_zero(F.col("reviewer_photo_count"), F.col("reviewer_review_count")),
        "review_language": F.coalesce(F.nullif(F.lower(stripped(F.col("review_language"))), F.lit("")), F.lit("unknown")),
        "has_review_text": has_content(F.col("review_text")),
        "has_sub_ratings": F.coalesce(*schema.SUB_RATINGS).isNotNull(),
        "has_owner_response": has_content(F.col("owner_response_text")),
        "was_edited": F.col("timestamp_edited_iso").isNotNull(),
    })
    return df.withColumn("review_detail_level", F.when(F.col("has_sub_ratings"), 2).when(F.col("has_review_text"), 1).otherwise(0))


def canonical_urls(df: DataFrame) -> DataFrame:
    """(place_id, canonical_url): the most frequent address of each place, the smallest of equally frequent ones."""
    counted = df.filter(F.col("place_id").isNotNull() & F.col("place_url").isNotNull()).groupBy("place_id", "place_url").count()
    return counted.groupBy("place_id").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("place_url").alias("url")))["url"].alias("canonical_url"))


def with_canonical_urls(df: DataFrame) -> DataFrame:
    return df.join(sent(canonical_urls(df)), "place_id", "left").withColumn("place_url", F.coalesce("canonical_url", "place_url")).drop("canonical_url")


def ambiguous_places(df: DataFrame) -> DataFrame:
    """Places with more than one address."""
    return df.groupBy("place_id").agg(F.count_distinct("place_url").alias("n_urls")).filter("n_urls > 1")


def latest(df: DataFrame, key: str, when: str, *tie: str) -> DataFrame:
    """The row of each key with the latest time; nulls come last, further columns break ties."""
    order = Window.partitionBy(key).orderBy(F.col(when).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie])
    return df.withColumn("place_in_key", F.row_number().over(order)).filter("place_in_key = 1").drop("place_in_key")


def clean(raw: DataFrame) -> DataFrame:
    """All steps: a review once, by its latest scrape, with an id and a place."""
    df = with_canonical_urls(derived(typed(missing_as_null(renamed(raw)))))
    df = latest(df, "review_id", "crawl_timestamp", "timestamp_created_iso", "place_url", "reviewer_user_id")
    return df.filter(F.col("review_id").isNotNull() & F.col("place_url").isNotNull())


def place_name_of(url) -> F.Column:
    """The decoded name in a place's address, else the address's last 50 characters."""
    data = F.regexp_extract(url, "(?s)/data=(.*?)(?:/data=|$)", 1)
    name = F.regexp_extract(data, "!1s([^!]+)!", 1)
    return F.when(name != "", F.coalesce(F.try_url_decode(name), name)).otherwise(F.right(url, F.lit(50)))
