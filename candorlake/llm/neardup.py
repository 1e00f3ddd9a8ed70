"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

1. One pass makes each text's set of word shingles, a 128-bit key of the set and a signature of
   COORDINATES minima. Texts with equal sets are one node from here on, however many they are.
2. Nodes are posted under each (coordinate, value) pair. Two nodes whose sets are similar enough agree in
   at least ``least_matches`` coordinates (all but about one linked pair in ten million; see there).
   A value that only one node has matches nothing, so a node with too few shared values is done.
3. Prefix: with a node's shared values in order of growing frequency, two nodes that agree in T of them
   have one in common among the first n - T + 1 of each. Frequent values, such as those of a licence
   text, fall out of the prefix unless a node consists of little else.
4. In each prefix list all nodes are paired with the first one only. Pairs that collide often enough are
   confirmed on their full sets; confirmed links make first components.
5. Skip: a list whose nodes are all in one component is done. The others are dealt out in blocks of BLOCK
   nodes; in a block, nodes of different components are compared by signature, and on their full sets where
   they collide often enough, most collisions first. A link joins two components, and their other pairs
   are passed over, so a block reports fewer links than it has nodes. A pair that shares several
   lists is looked at in the first of them.
6. Lists of more than one block that are still open: a node can be linked to another component only if
   enough of its shingles occur in other components of such lists too. Texts around a common passage, and
   copies that have found each other, drop out here. For the nodes left, every block of a list's
   largest component meets the nodes outside it, and those meet each other, likewise. So no link between
   components is lost, no task holds a whole list, and rows are written for blocks, not for pairs.

Edge cases: null text, empty text and text without a word have no shingles, stay alone and are kept;
repeated rows are exact copies; a null doc_id counts as larger than any id; an empty table gives an
empty result; a text of any length is taken whole; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candorlake.llm.common import by_keys, discard, id_and_text, lean, rows_of, stored
from candorlake.llm.shingles import shingle_sets, signatures
from candorlake.operators.graph import rooted

COORDINATES = 64
#: Standard deviations below its mean down to which a link's number of matching coordinates is sought.
MARGIN = 5.5
BLOCK = 256
#: Pairs of one node that are confirmed at a time.
AT_ONCE = 32
#: Candidate nodes are broadcast to the scan of the texts up to this many (about 100 bytes each).
BROADCAST_NODES = 300_000


def least_matches(percent: int, size: int = COORDINATES) -> int:
    """Matching coordinates that a pair at the threshold has all but about once in 10 million times:
    they are binomial with the similarity as their chance."""
    p = percent / 100
    return max(1, math.floor(size * p - MARGIN * math.sqrt(size * p * (1 - p))))


@lean("profiles")
def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in rows_of(batch):
            sets = shingle_sets(texts)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signed = [None if s is None else s.view(np.int32) for s in signatures(sets, COORDINATES)]
            rows = [hashlib.md5(b"%s:" % ("-" if i is None else str(i)).encode() + (t or b""), usedforsecurity=False).digest() for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.list_(pa.int32())), pa.array(rows, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "signature", "row_key"],
            )


def row_key(doc_id: Column, text: Column) -> Column:
    """What _profiles calls a row: a digest of its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary")))


@lean("profiles")
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, set)."""
    for batch in batches:
        for nodes, texts in rows_of(batch):
            sets = [s.tobytes() for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])


def _merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by sort and merge, for sides whose size Spark takes for far less than it is.

    It goes by the bytes of compressed files, shared out by the types of columns: to it an exploded array of 64 is
    one row, an array one value, and what copies have in common takes no room. A join left to that guess sends the
    whole side through the driver, however large.
    """
    return left.join(right.hint("merge"), on, how)


def _traits(prefix: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, signature, prefix, shingles) of the nodes in prefix lists, as a stored table.

    A node's text is found by the digest of one of its rows: an id, null say, may stand for any number of texts.
    """
    tokens = prefix.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("prefix"))
    wanted = stored(_merged(nodes, tokens, "node").select("node", "signature", "prefix", "row_key"))
    few = wanted.count() <= BROADCAST_NODES
    key = wanted.select("node", "row_key")
    texts = docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))).join(F.broadcast(key) if few else key.hint("merge"), "row_key")
    sets = texts.select("node", "text").mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"])
    found = stored(_merged(wanted, sets, "node").select("node", "signature", "prefix", "shingles"))
    discard(wanted)
    return found


@lean("neardup")
def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp, set) -> (shingle, node, comp, size of the set), a row for each shingle."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
            for at in range(0, len(own), 100_000):
                part = own[at : at + 100_000]
                fixed = (np.full(len(part), v, np.int64) for v in (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(part), *map(pa.array, fixed)], ["shingle", "node", "comp", "size"])


def _across(placed: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """The nodes of rows (node, comp) that may be linked to another component: a link needs percent of the union,
    so of each side's shingles, in common, and all of these then occur in two components."""
    sets = _merged(placed.select("node", "comp").distinct(), traits.select("node", "shingles"), "node")
    each = sets.select("node", "comp", "shingles").mapInArrow(_shingles, "shingle long, node long, comp long, size long")
    common = each.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("shingle")
    counted = _merged(each, common, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return counted.filter(100 * F.col("n") >= percent * F.col("size")).select("node")


def _linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets are similar enough to x; all sorted and without repeats."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    at = np.searchsorted(x, every)
    at[at == len(x)] = 0
    common = np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (len(x) + sizes - common)


def _confirmer(percent: int):
    @lean("neardup")
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(i)] for i in (2, 3)]
            good = pa.array([bool(_linked(x, [y], percent)[0]) for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return confirm


def _colliding(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough coordinates."""
    x = nodes.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    agree = F.aggregate(F.zip_with("x", "y", lambda i, j: (i == j).cast("int")), F.lit(0), lambda s, v: s + v)
    return _merged(_merged(pairs, x, "a"), y, "b").filter(agree >= matches).select("a", "b")


class _Union(dict):
    """Components that have been joined: each to an older one."""

    def root(self, c: int) -> int:
        while c in self:
            c = self[c]
        return c


def _block_links(token: int, left: list[int], right: list[int], rows: list[tuple], matches: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join components, between the rows numbered left and those numbered right.

    rows: (node, comp, signature, sorted prefix, shingles).
    """
    joined = _Union()
    right = np.array(right)
    node = np.array([r[0] for r in rows])
    comp = np.array([r[1] for r in rows])
    signature = np.array([rows[i][2] for i in right])
    earlier = [r[3][: np.searchsorted(r[3], token)] for r in rows]
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    inner = set(left) & set(right.tolist())
    for a in left:
        agree = (signature == np.asarray(rows[a][2])).sum(axis=1)
        fits = (agree >= matches) & (comp[right] != comp[a]) & (100 * np.minimum(sizes[right], sizes[a]) >= percent * np.maximum(sizes[right], sizes[a]))
        if a in inner:
            fits &= node[right] > node[a]
        order = np.flatnonzero(fits)
        order = order[np.argsort(-agree[order], kind="stable")]
        queue = [int(b) for b in right[order]]
        own = set(earlier[a].tolist())
        for at in range(0, len(queue), AT_ONCE):
            root = joined.root(int(comp[a]))
            some = [b for b in queue[at : at + AT_ONCE] if joined.root(int(comp[b])) != root and own.isdisjoint(earlier[b].tolist())]
            if not some:
                continue
            for b, linked in zip(some, _linked(sets[a], [sets[b] for b in some], percent)):
                x, y = joined.root(int(comp[a])), joined.root(int(comp[b]))
                if linked and x != y:
                    joined[y] = x
                    yield int(node[a]), int(node[b])


def _matcher(matches: int, percent: int):
    """Batches of (token, x, y, main, block, node, comp, signature, prefix, shingles), sorted by the first three.

    Group x >= 0: block x of the list's main component against block y of the rest. x < 0: blocks -1 - x
    and y of the rest.
    """

    def of_group(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        token, x, y = key
        others = [i for i, r in enumerate(rows) if not r[0]]
        left = [i for i in others if rows[i][1] == y]
        right = [i for i, r in enumerate(rows) if r[0]] if x >= 0 else [i for i in others if rows[i][1] == -1 - x]
        if not left or not right:
            return []
        return list(_block_links(token, left, right, [r[2:] for r in rows], matches, percent))

    @lean("neardup")
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []

        def flush() -> pa.RecordBatch:
            made = [pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)]
            found.clear()
            return pa.RecordBatch.from_arrays(made, ["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = zip(*[part.column(i).to_pylist() for i in range(3)])
                plain = [part.column(i).to_pylist() for i in range(3, 7)]
                arrays = [[v.values.to_numpy() for v in part.column(i)] for i in (7, 8)]
                for k, *row in zip(keys, *plain, *arrays, part.column(9).to_pylist()):
                    if k != key:
                        found += of_group(key, rows) if rows else []
                        key, rows = k, []
                    rows.append(tuple(row))
                if len(found) > 10_000:
                    yield flush()
        found += of_group(key, rows) if rows else []
        yield flush()

    return match


def _placed(prefix: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, node, comp) of all prefix lists, and (token, n) of those with several components."""
    placed = prefix.join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("comp"))
    return placed, _several(placed)


def _several(placed: DataFrame) -> DataFrame:
    """(token, n) of the lists with several components."""
    still = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low < high")
    return still.select("token", "n")


def _against_main(placed: DataFrame) -> DataFrame:
    """Deals out the lists (token, n, node, comp) so that each block of a list's largest component meets all
    other nodes, and those meet each other."""
    sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("top")).select("token", F.col("top.comp").alias("top"), F.col("top.size").alias("size"))
    rows = placed.join(largest, "token").withColumns({
        "main": F.col("comp") == F.col("top"),
        "mains": F.ceil(F.col("size") / BLOCK).cast("int"),
        "rests": F.ceil((F.col("n") - F.col("size")) / BLOCK).cast("int"),
    })
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    group = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = F.col("block")
    of_main = F.transform(every("rests"), lambda y: group(block, y))
    of_rest = F.concat(F.transform(every("mains"), lambda x: group(x, block)), F.transform(every("rests"), lambda y: group(-1 - F.least(block, y), F.greatest(block, y))))
    rows = rows.withColumn("group", F.explode(F.when(F.col("main"), of_main).otherwise(of_rest)))
    return rows.select("token", "group.x", "group.y", "main", "block", "node", "comp")


def _compared(dealt: DataFrame, traits: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links (a, b) found in groups of rows (token, x, y, main, block, node, comp)."""
    rows = _merged(dealt, traits, "node").select("token", "x", "y", "main", "block", "node", "comp", "signature", "prefix", "shingles")
    return stored(rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(_matcher(matches, percent), "a long, b long"))


def _groups(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_key, signature, row_key) of each row, and (set_key, least_id, root) of each set of
    shingles, both stored; sets that links reach have one root."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = id_and_text(docs)
    matches = least_matches(percent)
    rows = stored(docs.mapInArrow(_profiles, "doc_id long, n_shingles long, set_key binary, signature array<int>, row_key binary"))
    nodes = stored(rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.first("signature").alias("signature"), F.first("row_key").alias("row_key")).withColumn("node", F.monotonically_increasing_id()))

    posted = nodes.select("node", F.posexplode("signature").alias("at", "value")).select("node", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("token"))
    frequency = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    of_node = Window.partitionBy("node")
    shared = _merged(posted, frequency, "token").withColumns({"rank": F.row_number().over(of_node.orderBy("df", "token")), "n": F.count("*").over(of_node)})
    prefix = stored(shared.filter((F.col("n") >= matches) & (F.col("rank") <= F.col("n") - matches + 1)).select("token", "node"))

    listed = prefix.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    every, prefix = prefix, stored(_merged(prefix, listed, "token"))
    discard(every)
    traits = _traits(prefix, nodes, docs)

    pairs = prefix.select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    pairs = _colliding(pairs, nodes, matches)
    both = _merged(pairs, traits.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = _merged(both, traits.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_confirmer(percent), "a long, b long")
    roots = stored(rooted(links))
    used = [prefix, traits, nodes, roots]

    placed, still = _placed(prefix, roots)
    spread = placed.join(still, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    dealt = spread.select("token", (-1 - F.col("block")).alias("x"), F.col("block").alias("y"), F.lit(False).alias("main"), "block", "node", "comp")
    links = _compared(dealt, traits, matches, percent)
    roots = stored(rooted(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    used += [links, roots]

    placed, still = _placed(prefix, roots)
    large = stored(placed.join(still.filter(F.col("n") > BLOCK).select("token"), "token"))
    able = stored(_merged(large, _across(large, traits, percent), "node", "left_semi").select("token", "node", "comp"))
    used += [large, able]
    dealt = _against_main(able.join(_several(able), "token"))
    links = _compared(dealt, traits, matches, percent)
    roots = rooted(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    grouped = stored(nodes.join(roots, "node", "left").select("set_key", "least_id", F.coalesce("root", "node").alias("root")))
    discard(*used, links)  # what is returned is made of rows and grouped alone
    return rows, grouped


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text).

    Rows are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest id among all that links reach; kept rows are those whose own id it is.
    """
    rows, grouped = _groups(docs, percent)
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_set = _merged(grouped, least, "root").select("set_key", "component_id")
    out = rows.join(of_set, "set_key", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs but for all except one of each group of near copies, with all their columns.

    The row with the smallest id stays (a null id counts as larger than any), of those that share it the one with
    the smallest digest of id and text. Rows go by this digest: rows with one id and unlike texts are documents of
    their own, and so are those without an id. Rows that repeat id and text are one document, of which any one
    stays. Rows without a word stay.
    """
    rows, grouped = _groups(docs, percent)
    placed = _merged(rows.filter("n_shingles > 0"), grouped.select("set_key", "root"), "set_key")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_key").alias("key"))
    each = stored(placed.groupBy("row_key").agg(F.count("*").alias("n"), F.min("root").alias("root"), F.min(own).alias("row")))
    first = stored(each.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.key").alias("row_key")))
    lost = _merged(each, first, "row_key", "left_anti").select("row_key")
    again = _merged(each.filter("n > 1"), first, "row_key", "left_semi").select("row_key")
    name = "key_of_row"
    while name in docs.columns:
        name += "_"
    other, repeated = (stored(x.withColumnRenamed("row_key", name)) for x in (lost.unionByName(again), again))
    discard(rows, grouped, each, first)
    keyed = docs.withColumn(name, row_key(F.col("doc_id"), F.col("text")))
    one = by_keys(keyed, repeated, "left_semi").dropDuplicates([name])
    return by_keys(keyed, other, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
