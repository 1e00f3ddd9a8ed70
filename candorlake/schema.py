"""Columns of the review table: names in raw exports, types after cleaning."""

from __future__ import annotations

from pyspark.sql import types as T

#: Column titles of raw exports and their names here.
RAW_NAMES = {
    "Restaurant": "place_name",
    "Google Maps URL": "place_url",
    "Restaurant-Bewertung": "place_overall_rating",
    "Anzahl Bewertungen": "place_total_reviews",
    "Bewertungs-ID": "review_id",
    "Sterne": "rating_stars",
    "Bewertungstext": "review_text",
    "Sprache": "review_language",
    "Fotos": "review_images_count",
    "Erstellt am": "timestamp_created_iso",
    "Bearbeitet am": "timestamp_edited_iso",
    "Reviewer": "reviewer_name",
    "Reviewer-ID": "reviewer_user_id",
    "Avatar-URL": "reviewer_avatar_url",
    "Reviewer-Bewertungen": "reviewer_review_count",
    "Reviewer-Fotos": "reviewer_photo_count",
    "Reviewer-Profil-URL": "reviewer_profile_url",
    "Local Guide": "reviewer_is_local_guide",
    "Reviewer-Level": "reviewer_level",
    "Badge": "reviewer_badge",
    "Quelle": "review_source",
    "Quelle-Bewertung": "review_source_rating",
    "Essen (Bewertung)": "sub_rating_food",
    "Service (Bewertung)": "sub_rating_service",
    "Ambiente (Bewertung)": "sub_rating_atmosphere",
    "Mahlzeit": "attr_meal_type",
    "Preisgruppe": "attr_price_range",
    "Geräuschpegel": "attr_noise_level",
    "Verzehr": "attr_service_type",
    "Wartezeit": "attr_wait_time",
    "Gruppengröße": "attr_group_size",
    "Parkmöglichkeiten": "attr_parking",
    "Vegetarische Gerichte": "attr_vegetarian",
    "Restauranterantwort": "owner_response_text",
    "Antwort am": "owner_response_timestamp_iso",
    "Antwort-Sprache": "owner_response_language",
    "Scrapingzeit": "crawl_timestamp",
}
TIMESTAMPS = ("timestamp_created_iso", "timestamp_edited_iso", "owner_response_timestamp_iso", "crawl_timestamp")
NUMBERS = ("place_overall_rating", "place_total_reviews", "rating_stars", "review_images_count", "reviewer_review_count", "reviewer_photo_count", "reviewer_level", "sub_rating_food", "sub_rating_service", "sub_rating_atmosphere")
SUB_RATINGS = ("sub_rating_food", "sub_rating_service", "sub_rating_atmosphere")
ATTRIBUTES = ("attr_meal_type", "attr_price_range", "attr_noise_level", "attr_service_type", "attr_wait_time", "attr_group_size", "attr_parking", "attr_vegetarian")
TRUE_SPELLINGS = ("True", "true", "TRUE", "1", "yes", "Yes")
#: What a text reader of tables commonly takes for a missing value.
MISSING_SPELLINGS = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "<NA>", "#N/A")
SENSITIVE = ("reviewer_name", "reviewer_user_id", "reviewer_avatar_url", "reviewer_profile_url", "review_text", "owner_response_text")


def clean_type(name: str) -> T.DataType:
    if name in TIMESTAMPS:
        return T.TimestampType()
    if name in NUMBERS:
        return T.DoubleType()
    return T.BooleanType() if name == "reviewer_is_local_guide" else T.StringType()
