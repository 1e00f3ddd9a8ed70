"""The reviewer-place graph: metrics, reviewers with places in common, and the network score."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candorlake.functions.exprs import clip01, holds, share
from candorlake.session import written

LEAST_COMMON, MANY_COMMON, LEAST_EDGES = 3, 20, 3
#: Reviewers of a place that are compared with each other in one group; places of more are hot.
BLOCK = 256
#: Weights of the score's parts.
WEIGHTS = {"degree": 0.20, "homogeneity": 0.20, "bursts": 0.25, "common": 0.30, "co_burst": 0.05}


def edges(df: DataFrame, place: str = "place_id") -> DataFrame:
    """One edge a review between r_<reviewer> and p_<place>."""
    rows = df.filter(F.col("reviewer_user_id").isNotNull() & F.col(place).isNotNull())
    return rows.select(F.concat(F.lit("r_"), "reviewer_user_id").alias("src"), F.concat(F.lit("p_"), place).alias("dst"), "review_id", "rating_stars")


def vertices(edge: DataFrame) -> DataFrame:
    """(node, kind, edges, neighbours)."""
    both = edge.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edge.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    counted = both.groupBy("node").agg(F.count("*").alias("edges"), F.count_distinct("other").alias("neighbours"))
    return counted.select("node", F.when(F.col("node").startswith("r_"), "reviewer").otherwise("place").alias("kind"), "edges", "neighbours")


def reviewer_metrics(df: DataFrame, place: str = "place_id") -> DataFrame:
    """Degree (distinct places), edges, evenness of ratings, share of five stars and of burst reviews (in_burst)."""
    even = 1 - F.stddev_pop("rating_stars") / 4
    missing = F.count("*") > F.count("rating_stars")
    evenness = F.when(F.count("*") < LEAST_EDGES, 0.5).when(missing, 0.0).otherwise(F.greatest(F.lit(0.0), even))
    rows = df.repartition("reviewer_user_id")  # moves rows, not a row of sums for each place of a reviewer
    return rows.groupBy("reviewer_user_id").agg(F.count_distinct(place).alias("degree"), F.count("*").alias("edge_count"), evenness.alias("rating_homogeneity"), share(F.col("rating_stars") == 5).alias("pct_five_star"), share(holds(F.col("in_burst"))).alias("burst_edge_ratio"))


def co_reviewers(df: DataFrame, place: str = "place_id") -> DataFrame:
    """(reviewer_user_id, co_reviewer_count): with how many others a reviewer shares LEAST_COMMON places.

    Only reviewers of that many places count, and only places that two of them have visited. At a place of up to BLOCK
    visitors each gets the numbers of the others there, once a pair; a reviewer's task counts how often a number comes.
    That is a few bytes a pair, and at most BLOCK of them a visit. More visited places are left to the lists of such
    places alone (_by_lists), which tell the pairs with LEAST_COMMON of them in common; pairs with fewer, but with a
    place of the other kind, get theirs added.
    """
    visits = df.filter(F.col("reviewer_user_id").isNotNull() & F.col(place).isNotNull()).select(F.col("reviewer_user_id").alias("r"), F.col(place).alias("p"))
    able = written(visits.repartition("r").groupBy("r").agg(F.collect_set("p").alias("ps")).filter(F.size("ps") >= LEAST_COMMON).withColumn("c", F.monotonically_increasing_id()))
    able = _numbered(able)
    posted = able.select("c", F.explode("ps").alias("p")).repartition("p").withColumn("k", F.count("*").over(Window.partitionBy("p"))).filter("k > 1")
    places = written(posted.groupBy("p", "k").agg(F.array_sort(F.collect_list(F.when(F.col("k") <= BLOCK, F.col("c")))).alias("cs")))
    hot = places.filter(F.col("k") > BLOCK).select("p", "k")
    none = F.array().cast("array<long>")
    if hot.isEmpty():
        found = _counted(places.select("cs", none.alias("ms")))
        counts = found.select(F.col("a").alias("c"), "n")
    else:
        hot = written(hot.withColumn("id", F.monotonically_increasing_id()))
        lists = able.select("c", F.explode("ps").alias("p")).join(hot, "p").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "id")))["id"].alias("ps"))
        lists = written(lists)
        # A bit for each of a reviewer's hot places: pairs without a common bit have none in common.
        mask = F.aggregate("ps", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(63)).cast("int"))))
        posted = able.join(lists.select("c", mask.alias("m")), "c", "left").select("c", F.coalesce("m", F.lit(0).cast("long")).alias("m"), F.explode("ps").alias("p"))
        groups = posted.join(hot.select("p"), "p", "left_anti").repartition("p").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("x")).filter(F.size("x") > 1)
        found = written(_counted(groups.select(F.col("x.c").alias("cs"), F.col("x.m").alias("ms"))))
        side = lambda c: lists.select(F.col("c").alias(c), F.col("ps").alias(f"ps_{c}"))
        more = F.size(F.array_intersect("ps_a", "ps_b"))
        some = found.filter("b IS NOT NULL").join(side("a"), "a").join(side("b"), "b").filter((more < LEAST_COMMON) & (more + F.col("n") >= LEAST_COMMON))
        some = some.select(F.explode(F.array("a", "b")).alias("c"), F.lit(1).cast("long").alias("n"))
        counts = found.filter("b IS NULL").select(F.col("a").alias("c"), "n").unionByName(some).unionByName(_by_lists(lists.filter(F.size("ps") >= LEAST_COMMON)))
    counts = counts.groupBy("c").agg(F.sum("n").alias("co_reviewer_count"))
    return able.select("c", "r").join(counts, "c").select(F.col("r").alias("reviewer_user_id"), "co_reviewer_count")


def _numbered(rows: DataFrame) -> DataFrame:
    """c, from monotonically_increasing_id and written, as numbers without gaps; one count a file passes the driver."""
    sizes = dict(rows.groupBy(F.shiftright("c", 33).cast("int").alias("file")).agg(F.max("c").bitwiseAND(2**33 - 1).alias("n")).collect())
    starts, at = [], 0
    for file in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes[file] + 1 if file in sizes else 0
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), F.shiftright("c", 33).cast("int"))
    return rows.withColumn("c", (start + F.col("c").bitwiseAND(2**33 - 1)).cast("int"))


def _counted(places: DataFrame) -> DataFrame:
    """(a, b, n) from the sorted visitors cs of each place and, where there are hot places, their masks ms.

    Pairs without a common bit of their masks that have LEAST_COMMON of these places are counted: n of them for a, b
    is null. Those with a common bit come one by one, with the number of places.
    """
    at = F.posexplode("cs").alias("i", "a")
    after = lambda c: F.slice(c, F.col("i") + 2, F.size(c))
    each = places.select("cs", "ms", at).filter(F.col("i") + 1 < F.size("cs"))
    each = each.select("a", after("cs").alias("bs"), F.get("ms", F.col("i")).alias("m"), F.when(F.size("ms") > 0, after("ms")).alias("ms"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray) -> pa.RecordBatch:
            keys.sort()
            ends = np.append(np.flatnonzero(np.diff(keys)), len(keys) - 1)
            keys, n = keys[ends], np.diff(ends, prepend=-1)
            a, b, open_ = keys >> 32, (keys >> 1) & (2**31 - 1), (keys & 1) == 1
            sure = ~open_ & (n >= LEAST_COMMON)
            ids, times = np.unique(np.concatenate([a[sure], b[sure]]), return_counts=True)
            nulls = pa.nulls(len(ids), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, a[open_]]), pa.int32()), pa.concat_arrays([nulls, pa.array(b[open_], pa.int32())]), pa.array(np.concatenate([times, n[open_]]), pa.int64())], ["a", "b", "n"])

        rest = np.empty(0, np.int64)  # of the last reviewer so far, whose rows may go on
        for batch in batches:
            bs = batch.column("bs")
            if not batch.num_rows:
                continue
            a, sizes = batch.column("a").to_numpy().astype(np.int64), np.diff(bs.offsets.to_numpy())
            keys = (np.repeat(a, sizes) << 32) | (bs.flatten().to_numpy().astype(np.int64) << 1)
            if len(ms := batch.column("ms").flatten()):
                keys |= (np.repeat(batch.column("m").to_numpy(), sizes) & ms.to_numpy()) != 0
            keys = np.concatenate([rest, keys])
            last = (keys >> 32) == a[-1]
            rest = keys[last]
            if not last.all():
                yield out(keys[~last])
        if len(rest):
            yield out(rest)

    return each.repartition("a").sortWithinPartitions("a").mapInArrow(count, "a int, b int, n long")


def _by_lists(lists: DataFrame) -> DataFrame:
    """(c, n): with how many others a reviewer c shares LEAST_COMMON places of the list ps.

    Reviewers with the same places are one class with a size. With a class's n places in order of growing number of
    visitors, two classes with LEAST_COMMON places in common have one of them among the first n - LEAST_COMMON + 1 of
    both, so each is posted at those alone: places that many have visited, however many such places there are, fall
    out of nearly all lists, and those who went to the most visited ones only are few classes. Pairs found are
    confirmed on whole lists, each at its first common place. A place in the lists of many classes is dealt out in
    blocks, so that no task gets all its pairs.
    """
    classes = written(lists.groupBy("ps").agg(F.count("*").alias("size")).withColumn("c", F.monotonically_increasing_id()))
    posted = classes.select("c", "size", "ps", F.explode(F.slice("ps", F.lit(1), F.size("ps") - (LEAST_COMMON - 1))).alias("p"))
    blocks = posted.groupBy("p").agg(F.count("*").alias("m")).filter("m > 1").select("p", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    posted = posted.join(blocks, "p").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    both = F.transform(every, lambda y: F.struct(F.least(F.col("block"), y).alias("x"), F.greatest(F.col("block"), y).alias("y")))
    dealt = posted.select("p", "c", "size", "ps", "block", F.explode(both).alias("at"))
    a = dealt.filter(F.col("block") == F.col("at.x")).select("p", "at", F.col("c").alias("a"), F.col("size").alias("size_a"), F.col("ps").alias("x"))
    b = dealt.filter(F.col("block") == F.col("at.y")).select("p", "at", F.col("c").alias("b"), F.col("size").alias("size_b"), F.col("ps").alias("y"))
    pairs = a.join(b, ["p", "at"]).filter((F.col("a") < F.col("b")) | (F.col("at.x") != F.col("at.y")))
    common = F.array_intersect("x", "y")  # in the order of x, which is the same for all
    good = pairs.withColumn("common", common).filter((F.size("common") >= LEAST_COMMON) & (F.get("common", F.lit(0)) == F.col("p")))
    ends = F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("size_b").alias("n")), F.struct(F.col("b").alias("c"), F.col("size_a").alias("n")))).alias("e")
    others = good.select(ends).select("e.c", "e.n").unionByName(classes.select("c", (F.col("size") - 1).alias("n"))).groupBy("c").agg(F.sum("n").alias("n"))
    counted = classes.join(others.filter("n > 0"), "c").select("ps", "n")
    return lists.join(counted, "ps").select("c", "n")


def reviewer_scores(metrics: DataFrame, common: DataFrame, flagged: DataFrame) -> DataFrame:
    """Adds co_reviewer_count, in_co_burst, s_degree_homogeneity and network_score to the metrics.

    flagged: (reviewer_user_id) of co-bursts.
    """
    most = metrics.agg(F.max("degree").alias("most_"))
    rows = metrics.join(common, "reviewer_user_id", "left").join(flagged.distinct().withColumn("in_co_burst", F.lit(True)), "reviewer_user_id", "left")
    rows = rows.crossJoin(F.broadcast(most)).na.fill(0, ["co_reviewer_count"]).na.fill(False, ["in_co_burst"])
    rows = rows.withColumn("s_degree_homogeneity", F.col("degree") / F.nullif("most_", F.lit(0)) * F.col("rating_homogeneity"))
    # The weight times the degree as a decimal, divided then, is the SQL's way to the last bit.
    weighted = (F.col("degree") * F.lit(Decimal(str(WEIGHTS["degree"])))).cast("double")
    parts = {
        "homogeneity": F.col("rating_homogeneity"),
        "bursts": F.col("burst_edge_ratio"),
        "common": clip01(F.col("co_reviewer_count") / MANY_COMMON),
        "co_burst": F.col("in_co_burst").cast("double"),
    }
    first = F.coalesce(weighted / F.nullif("most_", F.lit(0)) * F.col("rating_homogeneity"), F.lit(0.0))
    return rows.withColumn("network_score", sum((F.coalesce(part, F.lit(0.0)) * WEIGHTS[k] for k, part in parts.items()), first)).drop("most_")


def scores(df: DataFrame, flagged: DataFrame, place: str = "place_id") -> DataFrame:
    """Network scores by review_id; df has in_burst."""
    by_reviewer = reviewer_scores(reviewer_metrics(df, place), co_reviewers(df, place), flagged)
    return df.select("review_id", "reviewer_user_id").join(by_reviewer, "reviewer_user_id", "left").drop("reviewer_user_id", "in_co_burst")
