"""Column expressions that several operators share; comparisons with a missing value are false."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"^\s+|\s+$"


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def share(condition: Column) -> Column:
    """Share of a group's rows for which a condition holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def clip01(x: Column) -> Column:
    """x held between 0 and 1; null stays."""
    return F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, SPACE, "")


def has_content(text: Column) -> Column:
    return holds(F.length(stripped(text)) > 0)


def steps(x: Column, limits: Sequence[tuple[float, float]], beyond: float, missing: float) -> Column:
    """The value of the first limit that x doesn't exceed."""
    out = F.when(x.isNull(), missing)
    for most, value in limits:
        out = out.when(x <= most, value)
    return out.otherwise(beyond)


def present(columns: Sequence[str]) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the values that are there, else null."""
    values = present(columns)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def row_std(columns: Sequence[str]) -> Column:
    """Sample standard deviation of the values that are there; null for fewer than two."""
    values, mean = present(columns), row_mean(columns)
    squares = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return holds(out)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def age_days(ts: Column, now: Column) -> Column:
    """Days between two times, with fractions."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400e6


def number_label(x: Column) -> Column:
    """A number as short text: whole ones without a decimal point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def find_column(names: Sequence[str], candidates: Sequence[str] = (), containing: str | None = None) -> str | None:
    """The first candidate that is there, else the first name that contains a text."""
    found = next((c for c in candidates if c in names), None)
    return found or next((n for n in names if containing and containing in n), None)
