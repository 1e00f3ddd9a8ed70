"""Readers and writers of files: raw exports, tables of scores, exports and reports."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERNS = ("reviews_complete*.csv", "merged_reviews*.csv")
DIALECT = {"sep": ";", "header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _file_system(spark, path)
    return fs.exists(at)


def raw_paths(spark: SparkSession, folder: str) -> list[str]:
    """The raw exports of a folder: complete ones if there are any, else merged ones; by name."""
    for pattern in PATTERNS:
        fs, at, _ = _file_system(spark, f"{folder.rstrip('/')}/{pattern}")
        if found := sorted(str(s.getPath()) for s in fs.globStatus(at) or []):
            return found
    raise FileNotFoundError(f"no {' or '.join(PATTERNS)} in {folder}")


def newest(spark: SparkSession, folder: str) -> str:
    """The raw export that was changed last."""
    fs, _, jvm = _file_system(spark, folder)
    paths = raw_paths(spark, folder)
    return max(paths, key=lambda p: (fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(p)).getModificationTime(), p))


def read_raw(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Raw rows as text, columns united by name. Files may differ in columns, so each is read with its own
    header; their number is that of exports, not of rows. file_order tells the files apart."""
    out = None
    for i, path in enumerate(paths):
        df = spark.read.options(**DIALECT).csv(path).withColumn("file_order", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_like_raw(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").options(sep=";", header=True, quoteAll=True, escape='"', compression=compression).csv(path)


def read_scores(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A score table, or an empty one of the same columns where a stage hasn't written any."""
    if exists(spark, path):
        return spark.read.parquet(path).select("review_id", *columns)
    return spark.createDataFrame([], T.StructType([T.StructField("review_id", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in columns]]))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Keeps (review_id, embedding) for later runs."""
    write_table(vectors.select("review_id", "embedding"), path)


def _changed(spark: SparkSession, path: str) -> int:
    """When the newest file of a table was written, as milliseconds; of a single file its own time."""
    fs, at, _ = _file_system(spark, path)
    return max((s.getModificationTime() for s in fs.listStatus(at)), default=0)


def read_vectors(spark: SparkSession, path: str, reviews: str) -> DataFrame | None:
    """The kept vectors, or None if there are none or they aren't newer than the table of reviews."""
    if not exists(spark, f"{path}/_SUCCESS") or exists(spark, reviews) and _changed(spark, path) <= _changed(spark, reviews):
        return None
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """one_file is for tables of bounded size, such as a top list."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(report, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    write_table(vertices, f"{path}/vertices")
    write_table(edges, f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """(path, path below the folder, length) of all files below a folder, without debug files and checkpoints."""
    fs, base, _ = _file_system(spark, folder)
    root = fs.getFileStatus(base).getPath().toString().rstrip("/")
    found = fs.listFiles(base, True)
    out = []
    while found.hasNext():
        status = found.next()
        path = status.getPath().toString()
        inside = path[len(root) :]
        name = inside.rsplit("/", 1)[-1]
        if "debug" not in name and not name.startswith(("_", ".")) and not re.search(r"/\.?[^/]*checkpoint[^/]*/", inside):
            out.append((path, inside, status.getLen()))
    return sorted(out)


def _digest(spark: SparkSession, path: str) -> str:
    """MD5 of a file of any size, read as a stream."""
    fs, at, jvm = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream)
    finally:
        stream.close()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, md5) of all files below a folder, without debug files and checkpoint folders.

    Exports are dozens of files; each is digested by a stream, so its size doesn't matter.
    """
    rows = [(inside, length, _digest(spark, path)) for path, inside, length in _listed(spark, folder)]
    return spark.createDataFrame(rows, "path string, length long, md5 string")


def changed_files(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files that a manifest doesn't have with the same content."""
    return now.join(known.select("path", "md5"), ["path", "md5"], "left_anti")


def upload(spark: SparkSession, folder: str, target: str) -> dict[str, int]:
    """Copies changed files to a store (any Hadoop file system) and keeps their manifest there.

    Files are those of exports, some dozens; each is copied by the store's own streams. The manifest is written
    last, so that files are copied again after a crash.
    """
    fs, base, jvm = _file_system(spark, folder)
    to, _, _ = _file_system(spark, target)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    now = manifest(spark, folder)
    at = f"{target.rstrip('/')}/_manifest"
    known = spark.read.parquet(at) if exists(spark, at) else spark.createDataFrame([], now.schema)
    todo = [r.path for r in changed_files(now, known).select("path").toLocalIterator()]
    for path in todo:
        source = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + path)
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, jvm.org.apache.hadoop.fs.Path(target.rstrip("/") + path), False, True, conf)
    now.coalesce(1).write.mode("overwrite").parquet(at)
    return {"uploaded": len(todo), "skipped": now.count() - len(todo)}


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, kind) of the catalog's tables and views."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(sorted(rows), "name string, kind string")


def query_parquet(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """Plain SQL over a Parquet path, which the query calls {t}."""
    return spark.sql(sql.replace("{t}", f"parquet.`{path}`"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV that write_csv made, with types found in its values."""
    return spark.read.options(header=True, inferSchema=True).csv(path)
