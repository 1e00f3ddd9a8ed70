"""Token totals by source, language and tokenizer version, kept up to date by signed batches.

A batch holds signed changes: an insert adds a document and its count, a delete takes both away, a
revised count adds the difference. Changes are summed by key before anything is written, so a batch
on disk is as small as its number of keys, whatever its number of documents, and a hot source is
summed on the side that reads it. Totals are sums of sums: additive, in any order.

Idempotence: a batch is written to a folder of its own attempt and counts from the moment that this folder is
renamed to the batch's name, a single step of the file system. The first commit of an id stands: a later one
of the same id, by a driver that died and starts over or by a second one, is refused as done, whatever it
holds. So there is no moment at which a committed batch is missing or half there.

compact() lists the committed batches once, sums just those and commits the sum as a snapshot together with
their ids in one rename; the batch folders are deleted after that. A batch that is committed meanwhile isn't on
the list and goes on counting by itself; a crash at any point leaves folders that count once or not at all.

Edge cases: null keys are keys of their own; a null count counts as 0; keys whose totals are all 0 are
left out; repeated rows in a batch are changes of their own and add up; no batches or empty ones give an empty
table; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Rows (source, lang, tokenizer, n_tokens) as additions."""
    return counts.select(*KEYS, F.lit(1).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("n_docs"), (-F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Rows (source, lang, tokenizer, old_tokens, n_tokens) as differences."""
    return counts.select(*KEYS, F.lit(0).alias("n_docs"), (F.coalesce("n_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).alias("n_tokens"))


class TokenRollup:
    """Totals below ``path``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self._path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        """Names of committed folders, less the prefix, in order."""
        top = self._new(self._path)
        if not self._fs.exists(top):
            return []
        return sorted(n.removeprefix(prefix) for n in (s.getPath().getName() for s in self._fs.listStatus(top)) if n.startswith(prefix))

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """The last snapshot, the ids folded into it, and the ids of further batches, from one look at the folder:
        batches first, as a compaction between two looks could only move listed ones into the snapshot."""
        batches = self._names("batch-")
        snapshots = self._names("snapshot-")
        if not snapshots:
            return None, set(), batches
        listed = self._spark.read.schema("value string").text(f"{self._path}/snapshot-{snapshots[-1]}/ids")
        folded = {r.value for r in listed.collect() if r.value}
        return snapshots[-1], folded, [b for b in batches if b not in folded]

    def _move(self, attempt: str, name: str) -> bool:
        """Renames an attempt's folder, unless the name is taken."""
        target = self._new(f"{self._path}/{name}")
        moved = not self._fs.exists(target) and self._fs.rename(self._new(attempt), target)
        # Some file systems move a folder into one that is there: then it is a file too many in a batch that is whole.
        inside = self._new(f"{self._path}/{name}/{attempt.rsplit('/', 1)[-1]}")
        if self._fs.exists(inside):
            self._fs.delete(inside, True)
            moved = False
        self._fs.delete(self._new(attempt), True)
        return bool(moved)

    def commit(self, batch_id: str, *changes: DataFrame) -> bool:
        """Adds the changes as one batch; False if the id has been committed before, and then nothing changes."""
        if not batch_id or "/" in batch_id:
            raise ValueError("a batch id must be a non-empty name without a slash")
        _, folded, batches = self._state()
        if batch_id in folded or batch_id in batches:
            return False
        every = changes[0]
        for more in changes[1:]:
            every = every.unionByName(more)
        attempt = f"{self._path}/attempt-{uuid.uuid4().hex}"
        self._summed(every).coalesce(1).write.parquet(attempt)
        return self._move(attempt, f"batch-{batch_id}")

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).filter(" OR ".join(f"{c} <> 0" for c in SUMS))

    def _sums(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self._path}/batch-{b}" for b in batches]
        paths += [f"{self._path}/snapshot-{snapshot}/sums"] if snapshot else []
        rows = self._spark.read.schema(SCHEMA).parquet(*paths) if paths else self._spark.createDataFrame([], SCHEMA)
        return self._summed(rows)

    def totals(self) -> DataFrame:
        snapshot, _, batches = self._state()
        return self._sums(snapshot, batches)

    def compact(self) -> None:
        """Folds what is committed into a new snapshot. One compaction at a time; commits may go on."""
        snapshot, folded, batches = self._state()
        attempt = f"{self._path}/attempt-{uuid.uuid4().hex}"
        ids = [(i,) for i in sorted(folded | set(batches))]
        self._spark.createDataFrame(ids, "value string").coalesce(1).write.text(f"{attempt}/ids")
        self._sums(snapshot, batches).coalesce(1).write.parquet(f"{attempt}/sums")
        if self._move(attempt, f"snapshot-{int(snapshot or -1) + 1:09d}"):
            for name in [f"batch-{b}" for b in batches] + ([f"snapshot-{snapshot}"] if snapshot else []):
                self._fs.delete(self._new(f"{self._path}/{name}"), True)

    def drop(self) -> None:
        """Deletes everything below the path."""
        self._fs.delete(self._new(self._path), True)
