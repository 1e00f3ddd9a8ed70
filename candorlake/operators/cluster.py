"""Density clusters of low-dimensional points: a grid join and connected components of core points."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorlake.operators.graph import components
from candorlake.session import written

BLOCK = 512


def projected(vectors: DataFrame, id_column: str, dims: int = 2) -> DataFrame:
    """(id, x0, x1): principal components; a linear stand-in for a neighbour-preserving projection."""
    rows = vectors.select(id_column, array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=dims, inputCol="v", outputCol="p").fit(rows)
    point = vector_to_array("p")
    return model.transform(rows).select(id_column, *[point[i].alias(f"x{i}") for i in range(dims)])


def _points(blocks: pa.ListArray, dims: int) -> Iterator[np.ndarray]:
    """Each block's points as a matrix."""
    for at in range(len(blocks)):
        yield blocks.slice(at, 1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _near_blocks(eps: float, dims: int):
    """(a, b, x, y): representatives of two cells and blocks of their points -> pairs with points within eps."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrow's own memory, not a Python object a point: a batch may hold thousands of pairs of blocks.
        for batch in batches:
            good = [bool((((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2) <= eps * eps).any()) for p, q in zip(_points(batch.column("x"), dims), _points(batch.column("y"), dims))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return check


def dbscan(points: DataFrame, id_column: str, eps: float = 0.5, least: int = 5, dims: int = 2) -> DataFrame:
    """(id, cluster): the smallest id of the cluster's core points, -1 for noise.

    The grid's cells are so small that all points of one are within eps of each other. A cell with ``least``
    points is core as a whole, without a look at pairs; only points of emptier cells are joined with
    the points around them, so a heap of points costs its number times a constant. Core points of a cell belong
    together; two cells do if blocks of BLOCK of their core points hold a pair within eps, which tasks
    compare as matrices. A border point joins the cluster of its smallest core neighbour. Ids must be numbers
    from 0 on.
    """
    axes, cell = [f"x{i}" for i in range(dims)], [f"c{i}" for i in range(dims)]
    width, reach = eps / math.sqrt(dims), math.ceil(math.sqrt(dims))
    rows = points.select(F.col(id_column).alias("id"), *axes, *[F.floor(F.col(x) / width).alias(c) for x, c in zip(axes, cell)])
    crowded = rows.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*cell)
    rows = written(rows.join(crowded.withColumn("crowded", F.lit(True)), cell, "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))))
    moves = F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(move)]) for move in product(range(-reach, reach + 1), repeat=dims)])
    around = lambda df: df.withColumn("move", F.explode(moves)).withColumns({c: F.col(c) + F.col(f"move.s{i}") for i, c in enumerate(cell)}).drop("move")
    other = rows.select(F.col("id").alias("other"), *[F.col(x).alias(f"o{x}") for x in axes], *cell)
    distance = sum(((F.col(x) - F.col(f"o{x}")) * (F.col(x) - F.col(f"o{x}")) for x in axes), F.lit(0.0))
    near = written(around(rows.filter("NOT crowded")).join(other, cell).filter(distance <= eps * eps).select("id", "other"))
    core = near.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("id").unionByName(rows.filter("crowded").select("id"))
    core = written(rows.join(core, "id", "left_semi").select("id", *axes, *cell))

    cells = core.groupBy(*cell).agg(F.min("id").alias("least_id"), F.count("*").alias("n"))
    packed = core.join(cells, cell).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
    packed = written(packed.groupBy(*cell, "least_id", "block").agg(F.collect_list(F.array(*axes)).alias("items")).drop("block"))
    a = around(packed.select(F.col("least_id").alias("a"), F.col("items").alias("x"), *cell))
    b = packed.select(F.col("least_id").alias("b"), F.col("items").alias("y"), *cell)
    kind = core.schema["id"].dataType.simpleString()
    linked = a.join(b, cell).filter("a < b").select("a", "b", "x", "y").mapInArrow(_near_blocks(eps, dims), f"a {kind}, b {kind}")
    roots = components(linked.unionByName(cells.select(F.col("least_id").alias("a"), F.col("least_id").alias("b"))).toDF("src", "dst"))

    of_core = core.join(cells.select(*cell, F.col("least_id").alias("node")), cell).join(roots, "node").select("id", "component")
    border = near.join(core.select("id"), "id", "left_anti").join(core.select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(F.min("other").alias("via"))
    of_border = border.join(of_core.select(F.col("id").alias("via"), "component"), "via").select("id", "component")
    found = of_core.unionByName(of_border)
    return points.select(F.col(id_column).alias("id")).join(found, "id", "left").select(F.col("id").alias(id_column), F.coalesce("component", F.lit(-1)).alias("cluster"))
