"""Shared helpers: reading tables, walking Arrow batches, filters by text or key, row samples."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candorlake.session import discard, shared_folder  # noqa: F401
from candorlake.session import written as stored  # noqa: F401

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators need; whatever else the table carries is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rows_of(batch: pa.RecordBatch, binary: bool = True) -> Iterator[tuple[list, list]]:
    """(doc ids, texts) of small slices; texts are UTF-8 bytes or str, None for null."""
    ids, texts = batch.column(0), batch.column(1)
    if binary:
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield ids.slice(at, SLICE_ROWS).to_pylist(), texts.slice(at, SLICE_ROWS).to_pylist()


#: What Python workers keep between tasks: by owner, how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Registers a memo that may outlive a task; a task of another owner clears it first."""
    _KEPT[owner] = clear


def _let_go() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: memory stays with the worker
        pass


def lean(owner: str):
    """Makes a function over Arrow batches start without the memos of other owners, and hand free memory back
    to the machine when it ends: idle workers share it with the JVM."""

    def wrap(f):
        @functools.wraps(f)
        def run(batches):
            for name, clear in _KEPT.items():
                if name != owner:
                    clear()
            try:
                yield from f(batches)
            finally:
                _let_go()

        return run

    return wrap


def release(spark: SparkSession) -> None:
    """Lets executors collect garbage, so that their heaps shrink to what is in use. A JVM keeps what it has
    taken until a full collection; Python workers share the machine with it, and their models need room."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def bucket(doc_id, parts: int):
    """crc32 of the id's decimal text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % F.lit(parts)


#: Labels or languages whose counts are broadcast at most.
FEW_KEYS = 10_000


def lowest_hashes(rows: DataFrame, key: str, count: int) -> DataFrame:
    """Of rows (doc_id, key), for each key the ``count`` with the smallest hash of their id.

    Ids are counted by key first, by a sketch that is off by 2 % or so. Of n ids, those whose hash is below a share of
    1.2 * (count + 8 * sqrt(count) + 16) / n are enough all but about once in 10^12 keys (then the sample is a little
    smaller), and only they are ranked: a key that holds most of the table is no more work for a task than others.
    Rows that repeat id and key are taken once, however many they are; those without an id are not.
    """
    rows = rows.filter(F.col("doc_id").isNotNull())
    sizes = rows.groupBy(key).agg(F.approx_count_distinct("doc_id", 0.02).alias("of_key"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    share = 1.2 * (count + 8 * count**0.5 + 16) / F.col("of_key")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_KEYS else sizes
    few = rows.join(sizes, key).withColumn("place", place).filter(F.col("place") < share).select("doc_id", key, "place").distinct()
    order = Window.partitionBy(key).orderBy("place", "doc_id")
    return few.withColumn("place_in_key", F.row_number().over(order)).filter(F.col("place_in_key") <= count).select("doc_id", key)


#: Keys that are broadcast at most, some 16 MB; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def by_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A semi or anti join of rows with one column of keys; null is never among them."""
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, keys.columns[0], how)


def filtered(docs: DataFrame, owner: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of docs, all columns as they are, for whose text a function over texts says so.

    make: builds the function once a task; it gets up to SLICE_ROWS texts, None for null.
    """
    place = docs.columns.index("text")

    @lean(owner)
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = make()
        for batch in batches:
            texts = batch.column(place)
            mask: list[bool] = []
            for at in range(0, batch.num_rows, SLICE_ROWS):
                mask += good(texts.slice(at, SLICE_ROWS).to_pylist())
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
