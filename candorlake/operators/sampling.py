"""A stratified sample for debugging: every stratum, most of them in proportion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARE, LEAST, MOST, LEAST_PER_STRATUM, SEED = 0.15, 5000, 9000, 20, 42
#: Hashes are counted by their first bits.
BUCKET_BITS = 12


def target_size(rows: int) -> int:
    return min(max(LEAST, min(MOST, int(rows * SHARE))), rows)


def stratified(df: DataFrame, stratum: str, key: str, target: int | None = None, seed: int = SEED) -> DataFrame:
    """``target`` rows: max(20, proportional) of each stratum, then trimmed to the target with one of each kept.

    Rows are drawn by a hash of their key, so a rerun draws the same. A stratum's quota is cut by its hash: the
    quantile that leaves as many rows is found among the hashes by counts in buckets, not by sorting a stratum
    in one task; the few rows of the last bucket are ranked. The target is a debugging sample's: thousands.
    """
    total = df.count()
    target = target_size(total) if target is None else target
    if target >= total:
        return df
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size_"))
    quota = F.least(F.col("size_"), F.greatest(F.lit(LEAST_PER_STRATUM), F.bround(F.col("size_") / F.lit(total) * F.lit(target)).cast("long")))
    sizes = sizes.select(F.col(stratum).alias("stratum_"), quota.alias("quota_"))
    drawn = df.withColumns({"drawn_": F.xxhash64(F.col(key), F.lit(seed)), "bucket_": F.shiftright(F.xxhash64(F.col(key), F.lit(seed)), 64 - BUCKET_BITS)})
    drawn = _lowest(drawn, sizes, stratum, key)
    over = max(0, sizes.agg(F.sum("quota_")).first()[0] - target)
    if not over:
        return drawn.select(*df.columns)
    # Trim: one row of each stratum stays, the others compete as one stratum.
    spare = sizes.select("stratum_").count()
    first = F.row_number().over(Window.partitionBy(stratum).orderBy("drawn_", key)) == 1
    marked = drawn.withColumn("first_", first)
    rest = _lowest(marked.filter("NOT first_").withColumn("all_", F.lit(0)), df.sparkSession.createDataFrame([(0, max(0, target - spare))], "stratum_ int, quota_ long"), "all_", key)
    return marked.filter("first_").select(*df.columns).unionByName(rest.select(*df.columns))


def _lowest(rows: DataFrame, quotas: DataFrame, stratum: str, key: str) -> DataFrame:
    """The rows (drawn_, bucket_) with the smallest hashes, quota_ of each stratum."""
    counted = rows.groupBy(F.col(stratum).alias("stratum_"), "bucket_").agg(F.count("*").alias("n_"))
    upto = Window.partitionBy("stratum_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("s_").eqNullSafe(F.col("stratum_"))
    ends = counted.withColumn("end_", F.sum("n_").over(upto)).withColumnRenamed("stratum_", "s_").join(quotas, same)
    ends = ends.filter(F.col("end_") - F.col("n_") < F.col("quota_")).select(F.col("s_"), F.col("bucket_").alias("b_"), (F.col("quota_") - F.col("end_") + F.col("n_")).alias("left_"), (F.col("end_") > F.col("quota_")).alias("cut_"))
    kept = rows.join(ends, F.col(stratum).eqNullSafe(F.col("s_")) & (F.col("bucket_") == F.col("b_")))
    rank = F.row_number().over(Window.partitionBy(stratum, "bucket_").orderBy("drawn_", key))
    last = kept.filter("cut_").withColumn("rank_", rank).filter(F.col("rank_") <= F.col("left_")).drop("rank_")
    return kept.filter("NOT cut_").unionByName(last).drop("s_", "b_", "left_", "cut_")
