"""Data checks: one pass for all counts, rows that fail for the rest, and a gate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorlake import schema

REQUIRED = ("review_id", "rating_stars", "place_url", "reviewer_user_id", "timestamp_created_iso")
NEVER_NULL = ("review_id", "place_url", "reviewer_user_id")
LEAST_ROWS = 1000
#: The least filled share of each column below which its coverage is in doubt.
COVERAGE = {
    "attr_noise_level": 0.10,
    "attr_wait_time": 0.05,
    "attr_group_size": 0.08,
    "attr_parking": 0.03,
    "attr_vegetarian": 0.07,
    "owner_response_text": 0.10,
    "owner_response_timestamp_iso": 0.10,
    "owner_response_language": 0.10,
}
SUB_RATING_COVERAGE, ANY_COVERAGE = 0.20, 0.01


class Report(NamedTuple):
    critical: list[str]
    soft: list[str]
    fill: dict[str, float]

    @property
    def success(self) -> bool:
        return not self.critical


def fill_rates(df: DataFrame) -> DataFrame:
    """(column_name, non_null, fill_rate) for every column, emptiest first; one aggregate."""
    names = df.columns
    counts = df.agg(F.count("*").alias("n_rows_"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("non_null")) for i, c in enumerate(names)])).alias("x")
    rows = counts.select("n_rows_", each).select("x.*", F.round(F.col("x.non_null") / F.nullif("n_rows_", F.lit(0)), 4).alias("fill_rate"))
    return rows.orderBy("fill_rate", "column_name")


def quality_report(df: DataFrame, masked: bool = True) -> DataFrame:
    """Type, missing values and an example for every column; examples of sensitive columns masked."""
    names = df.columns
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("n_rows_"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)], *[F.min(F.col(f"`{c}`").cast("string")).alias(f"x{i}") for i, c in enumerate(names)])
    example = lambda i, c: F.when(F.col(f"x{i}").isNotNull(), "[REDACTED]") if masked and c in schema.SENSITIVE else F.col(f"x{i}")
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), (F.col("n_rows_") - F.col(f"c{i}")).alias("n_null"), example(i, c).alias("example")) for i, c in enumerate(names)]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def check(df: DataFrame) -> Report:
    """Critical and soft findings on clean reviews, from one aggregate and a count of ids."""
    critical, soft = [], []
    if absent := [c for c in REQUIRED if c not in df.columns]:
        critical.append(f"missing columns: {', '.join(absent)}")
    measures = [F.count("*").alias("n")] + [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    if "rating_stars" in df.columns:
        measures.append(F.count_if(~F.col("rating_stars").between(1, 5)).alias("bad_stars"))
    got = df.agg(*measures).first().asDict()
    if "review_id" in df.columns:  # on its own: beside the others, each id would be shuffled with a row of their sums
        got["ids"] = df.select(F.count_distinct("review_id")).first()[0]
    n = got["n"]
    filled = {c: got[f"c{i}"] for i, c in enumerate(df.columns)}
    critical += [f"{c}: {n - filled[c]} null values" for c in NEVER_NULL if c in filled and filled[c] < n]
    if got.get("bad_stars"):
        critical.append(f"rating_stars: {got['bad_stars']} outside 1 to 5")
    if "ids" in got:
        distinct = got["ids"] + (filled["review_id"] < n)  # nulls are one value
        if distinct < n:
            critical.append(f"review_id: {n - distinct} repeats")
    if n < LEAST_ROWS:
        critical.append(f"{n} rows, fewer than {LEAST_ROWS}")
    rate = {c: v / n if n else 0.0 for c, v in filled.items()}
    soft += [f"{c}: filled {rate[c]:.1%}, least {SUB_RATING_COVERAGE:.0%}" for c in schema.SUB_RATINGS if c in rate and rate[c] < SUB_RATING_COVERAGE]
    soft += [f"{c}: absent" if c not in rate else f"{c}: filled {rate[c]:.1%}, least {least:.0%}" for c, least in COVERAGE.items() if rate.get(c, -1) < least]
    soft += [f"{c}: nearly empty" for c, r in rate.items() if r < ANY_COVERAGE]
    return Report(critical, soft, {c: round(r, 4) for c, r in sorted(rate.items(), key=lambda x: x[1])})


def gate(df: DataFrame) -> Report:
    report = check(df)
    if not report.success:
        raise RuntimeError("; ".join(report.critical))
    return report


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def unaccepted(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Values other than the accepted ones, with their number of rows."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose value has no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def run_suite(df: DataFrame, suite: dict) -> dict[str, bool]:
    """A small runner of declared expectations (row count, existence, not null, unique, range, set)."""
    out: dict[str, bool] = {}
    for i, e in enumerate(suite["expectations"]):
        kind, args = e["expectation_type"], e["kwargs"]
        column = args.get("column")
        if kind == "expect_table_row_count_to_be_between":
            ok = args.get("min_value", 0) <= df.count() <= args.get("max_value", float("inf"))
        elif column not in df.columns:
            ok = False
        elif kind == "expect_column_values_to_not_be_null":
            ok = null_rows(df, column).isEmpty()
        elif kind == "expect_column_values_to_be_unique":
            ok = repeated_values(df, column).isEmpty()
        elif kind == "expect_column_values_to_be_between":
            ok = df.filter((F.col(column) < args.get("min_value", float("-inf"))) | (F.col(column) > args.get("max_value", float("inf")))).isEmpty()
        elif kind == "expect_column_values_to_be_in_set":
            ok = unaccepted(df, column, args["value_set"]).isEmpty()
        elif kind == "expect_column_to_exist":
            ok = True
        else:
            raise ValueError(f"unknown expectation {kind}")
        out[f"{i}:{kind}:{column or ''}"] = bool(ok)
    return out
