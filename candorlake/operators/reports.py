"""The tables behind plots and printed analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candorlake.functions.quantiles import exact_quantiles, quantiles_by

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n) of equal bins, the last one closed."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.filter(F.col(column).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box_plot(df: DataFrame, by: str, column: str) -> DataFrame:
    rows = df.filter(F.col(by).isNotNull() & F.col(column).isNotNull())
    ends = rows.groupBy(by).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))
    middle = quantiles_by(rows, by, column, (0.25, 0.5, 0.75)).withColumnsRenamed({"p25": "q1", "p50": "median", "p75": "q3"})
    return ends.join(middle, by).select(by, "low", "q1", "median", "q3", "high", "n")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def statistics(df: DataFrame, column: str) -> DataFrame:
    one = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"))
    return one.crossJoin(F.broadcast(exact_quantiles(df, column, [0.5]))).withColumnRenamed("p50", "median")


def month_pivot(df: DataFrame, ts: str, flag: str, since: str | None = None) -> DataFrame:
    """(month, n_false, n_true), months without either left out."""
    rows = df.withColumn("month", F.date_format(ts, "yyyy-MM")).filter(F.col("month").isNotNull())
    rows = rows.filter(F.col("month") >= since) if since else rows
    return rows.groupBy("month").pivot(flag, [False, True]).count().na.fill(0).withColumnsRenamed({"false": "n_false", "true": "n_true"})


def weekday_hours(df: DataFrame, ts: str) -> DataFrame:
    """(weekday, h0 to h23), zero filled, in the order of the week."""
    rows = df.filter(F.col(ts).isNotNull()).withColumns({"weekday": F.date_format(ts, "EEEE"), "hour": F.hour(ts)})
    wide = rows.groupBy("weekday").pivot("hour", list(range(24))).count().na.fill(0).withColumnsRenamed({str(h): f"h{h}" for h in range(24)})
    return wide.orderBy(F.array_position(F.array(*map(F.lit, DAYS)), F.col("weekday")))


def month_bursts(df: DataFrame, ts: str, place: str, least: int = 3) -> DataFrame:
    """Places and months with at least so many rows."""
    return df.groupBy(place, F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def ranking(df: DataFrame, by: str, column: str, count: int = 20) -> DataFrame:
    return df.groupBy(by).agg(F.avg(column).alias("mean_score"), F.count("*").alias("n")).orderBy(F.desc("mean_score"), by).limit(count)


def means(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def top_per_group(df: DataFrame, by: str, column: str, tie: str, count: int = 2) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(column), tie)
    return df.withColumn("place_in_group", F.row_number().over(order)).filter(F.col("place_in_group") <= count)


def flag_contrast(df: DataFrame, flag: str, column: str, ts: str) -> DataFrame:
    """Means of a column with and without a flag, share flagged, and the first and last time."""
    return df.agg(F.avg(F.when(F.col(flag), F.col(column))).alias("mean_flagged"), F.avg(F.when(~F.col(flag), F.col(column))).alias("mean_rest"), F.avg(F.col(flag).cast("double")).alias("share_flagged"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))


def cluster_means(df: DataFrame, cluster: str, score: str) -> DataFrame:
    """Size and mean score of each cluster but noise (-1), and whether it lies above the overall mean."""
    overall = df.agg(F.avg(score).alias("overall"))
    rows = df.filter(F.col(cluster) != -1).groupBy(cluster).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))
    return rows.crossJoin(F.broadcast(overall)).withColumn("above", F.col("mean_score") > F.col("overall")).drop("overall")


def cluster_verdict(df: DataFrame, cluster: str, score: str) -> DataFrame:
    """Clusters, those above the mean, the spread of their means and what it amounts to."""
    rows = cluster_means(df, cluster, score).agg(F.count("*").alias("n_clusters"), F.count_if("above").alias("n_above"), F.coalesce(F.max("mean_score") - F.min("mean_score"), F.lit(0.0)).alias("spread"))
    return rows.withColumn("verdict", F.when((F.col("spread") > 0.15) & (F.col("n_above") >= 2), "clear").when(F.col("spread") > 0.05, "weak").otherwise("none"))
