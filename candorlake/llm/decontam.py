"""Benchmark decontamination: every training passage is a query to a BM25 index of the test items.

Index: a test item of over STEP words is cut into units of at most STEP words. Each unit's BM25 weight of a
term is divided by the unit's weight of its own text, so a score is the share of the unit that the
passage covers, and one threshold holds for all. Units stand in blocks of BLOCK; the index keeps each
posting, the largest weight of each term in each block, and of each term at all.

Search: passages of 2 * STEP words start every STEP words, so each stretch of STEP words lies
whole in one. For each, as in block-max WAND, (1) passages whose terms' largest weights cannot add up to the
threshold are passed over; (2) blocks whose bounds cannot are, first with the rare terms' block maxima
and the frequent ones' overall maxima, then with the block maxima of both; (3) what is left is scored
exactly. Bounds are never below a score, so all above the threshold are retrieved. The steps run on
arrays of many passages at once.

Check: the last sentence of an item is its answer, the rest its question (an item of one sentence: the last
quarter of its words). A hit counts if half of the word triples of both are in the document around the
passage, or seven tenths of all of the item's.

The index of ITEM_CHARS of test text at most is sent to the workers; a larger test set is cut by hash into
as many parts as that takes, with a pass over the documents for each. Document frequencies are always
those of the whole test set, counted by Spark.

Edge cases: null or empty documents and items match nothing; repeated items are reported once per item_id,
repeated documents once a row; a null doc_id stays null; ties at the threshold count as hits; a text of any length
is searched whole, passage by passage; empty tables give an empty result; other columns, of whatever name, are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorlake.llm.common import filtered, id_and_text, lean, rows_of, stored

K1, B = 1.2, 0.75
STEP, BLOCK = 64, 4
THRESHOLD = 0.5
GRAM, BOTH_PARTS, WHOLE = 3, 0.5, 0.7
ITEM_CHARS = 16_000_000
#: A term in over this share of the units is frequent.
FREQUENT = 1 / 16
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return set(zip(*[words[i:] for i in range(n)])) if n else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    at = len(words) - max(1, len(words) // 4)
    return words[:at], words[at:]


class Item(NamedTuple):
    item_id: Any
    n_words: int
    question: set
    answer: set


def shared(part: set, words: list[str]) -> set:
    """The word runs of a part of an item that are also among the words."""
    n = len(next(iter(part), ()))
    return part & set(zip(*[words[i:] for i in range(n)])) if n else part


def units_of(text: str | None) -> list[list[str]]:
    words = words_of(text)
    return [words[i : i + STEP] for i in range(0, len(words), STEP)]


def _stretches(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches first, first + 1, ... of given lengths: the number of the stretch, and each place in it."""
    of = np.repeat(np.arange(len(first)), lengths)
    return of, np.arange(len(of)) + (first - (np.cumsum(lengths) - lengths))[of]


class Index:
    """Inverted lists of one part of the test set, with the bounds that the search needs."""

    def __init__(self, items: list[tuple[Any, str]], frequency: dict[str, int], n_units: int, mean_words: float):
        self.items: list[Item] = []
        owner: list[int] = []
        postings: list[tuple[str, int, float]] = []
        for item_id, text in sorted(items, key=lambda x: (str(x[0]), x[1])):
            question, answer = question_and_answer(text)
            self.items.append(Item(item_id, len(words_of(text)), _grams(question), _grams(answer)))
            for words in units_of(text):
                weights = {}
                for term, tf in Counter(words).items():
                    idf = math.log1p((n_units - frequency[term] + 0.5) / (frequency[term] + 0.5))
                    weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
                whole = sum(weights.values())
                postings += [(t, len(owner), w / whole) for t, w in weights.items()]
                owner.append(len(self.items) - 1)
        self.owner = np.array(owner, dtype=np.int64)
        self.vocabulary = {t: i for i, t in enumerate(sorted({p[0] for p in postings}))}
        self.n_blocks = -(-len(owner) // BLOCK)
        size = len(self.vocabulary)
        term = np.array([self.vocabulary[p[0]] for p in postings], dtype=np.int64)
        unit = np.array([p[1] for p in postings], dtype=np.int64)
        weight = np.array([p[2] for p in postings], dtype=np.float64)
        order = np.lexsort((unit, term))
        self.unit, self.weight, term = unit[order], weight[order], term[order]
        self.largest = np.zeros(size)
        np.maximum.at(self.largest, term, self.weight)
        cells, first = np.unique(term * max(1, self.n_blocks) + self.unit // BLOCK, return_index=True)
        #: A cell is a term in a block: its largest weight and its stretch of postings.
        self.cells, self.cell_start = cells, np.append(first, len(term))
        self.cell_block = cells % max(1, self.n_blocks)
        self.cell_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.term_cells = np.searchsorted(cells // max(1, self.n_blocks), np.arange(size + 1))
        lists = np.bincount(term, minlength=size)
        self.frequent = lists > FREQUENT * len(owner)
        dense = np.flatnonzero(self.frequent)
        self.dense_row = np.full(size, -1)
        self.dense_row[dense] = np.arange(len(dense))
        self.dense_max = np.zeros((len(dense), self.n_blocks))
        on = self.frequent[cells // max(1, self.n_blocks)]
        self.dense_max[self.dense_row[cells[on] // max(1, self.n_blocks)], self.cell_block[on]] = self.cell_max[on]

    def search(self, lists: list[list[str]]) -> Iterator[tuple[int, int, int, float]]:
        """(document's place in the list, passage's first word, unit, score) of all hits."""
        look = self.vocabulary.get
        ids = [np.fromiter(map(look, w, repeat(-1)), np.int64, len(w)) for w in lists]
        counts = [-(-len(w) // STEP) for w in lists]
        if not sum(counts) or not self.n_blocks:
            return
        doc_of = np.repeat(np.arange(len(lists)), counts)
        base = np.cumsum([0, *counts])[:-1]
        step = np.concatenate([s + np.arange(len(w)) // STEP for s, w in zip(base, lists)])
        every = np.concatenate(ids)
        known = every >= 0
        step, every = step[known], every[known]
        bound = np.bincount(step, self.largest[every], minlength=len(doc_of))
        follows = np.append(doc_of[1:] == doc_of[:-1], False)
        passage_bound = bound + np.where(follows, np.append(bound[1:], 0), 0)
        slack = THRESHOLD - 1e-9
        live = passage_bound >= slack
        if not live.any():
            return
        size = len(self.vocabulary)
        own = live[step]
        before = (step > 0) & follows[step - 1] & live[step - 1]
        pairs = np.unique(np.concatenate([step[own] * size + every[own], (step[before] - 1) * size + every[before]]))
        passage, term = pairs // size, pairs % size
        live = np.bincount(passage, self.largest[term], minlength=len(doc_of)) >= slack
        keep = live[passage]
        passage, term = passage[keep], term[keep]
        numbers, place = np.unique(passage, return_inverse=True)
        starts = np.searchsorted(place, np.arange(len(numbers) + 1))
        chunk = max(1, 2_000_000 // self.n_blocks)
        for lo in range(0, len(numbers), chunk):
            hi = min(len(numbers), lo + chunk)
            part = slice(starts[lo], starts[hi])
            p, b = self._blocks(place[part] - lo, term[part], hi - lo, slack)
            for at in range(0, len(p), 20_000):
                for place_, unit, score in self._scores(p[at : at + 20_000] + lo, b[at : at + 20_000], term, starts, slack):
                    number = int(numbers[place_])
                    doc = int(doc_of[number])
                    yield doc, int(number - base[doc]) * STEP, unit, score

    def _blocks(self, place: np.ndarray, term: np.ndarray, n: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Passages and blocks whose bounds reach the threshold."""
        often = self.frequent[term]
        rest = np.bincount(place[often], self.largest[term[often]], minlength=n)
        rare_place, rare_term = place[~often], term[~often]
        first, last = self.term_cells[rare_term], self.term_cells[rare_term + 1]
        lengths = last - first
        of, cells = _stretches(first, lengths)
        sums = np.bincount(rare_place[of] * self.n_blocks + self.cell_block[cells], self.cell_max[cells], minlength=n * self.n_blocks).reshape(n, self.n_blocks)
        p, b = np.nonzero(sums + rest[:, None] >= slack)
        bounds = np.searchsorted(place[often], np.arange(n + 1))
        rows = self.dense_row[term[often]]
        lengths = (bounds[1:] - bounds[:-1])[p]
        of, at = _stretches(bounds[p], lengths)
        full = sums[p, b] + np.bincount(of, self.dense_max[rows[at], b[of]], minlength=len(p))
        good = full >= slack
        return p[good], b[good]

    def _scores(self, p: np.ndarray, b: np.ndarray, term: np.ndarray, starts: np.ndarray, slack: float) -> Iterator[tuple[int, int, float]]:
        """(passage, unit, score) at or above the threshold in the blocks b of passages p."""
        first, lengths = starts[p], starts[p + 1] - starts[p]
        of, at = _stretches(first, lengths)
        wanted = term[at] * self.n_blocks + b[of]
        cell = np.searchsorted(self.cells, wanted)
        cell[cell == len(self.cells)] = 0
        hit = self.cells[cell] == wanted
        of, cell = of[hit], cell[hit]
        which, posting = _stretches(self.cell_start[cell], self.cell_start[cell + 1] - self.cell_start[cell])
        slot = of[which] * BLOCK + self.unit[posting] % BLOCK
        sums = np.bincount(slot, self.weight[posting], minlength=len(p) * BLOCK)
        for i in np.flatnonzero(sums >= slack):
            yield int(p[i // BLOCK]), int(b[i // BLOCK]) * BLOCK + int(i % BLOCK), float(sums[i])

    def contaminated(self, lists: list[list[str]]) -> list[dict[int, tuple[float, float, float]]]:
        """For each document: item -> (best score, question overlap, answer overlap) of confirmed hits."""
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in lists]
        for doc, start, unit, score in self.search(lists):
            i = int(self.owner[unit])
            item = self.items[i]
            near = lists[doc][max(0, start - item.n_words) : start + 2 * STEP + item.n_words]
            question, answer = shared(item.question, near), shared(item.answer, near)
            both = min(len(question) / max(1, len(item.question)), len(answer) / max(1, len(item.answer)))
            whole = (len(question) + len(answer)) / (len(item.question) + len(item.answer))
            if both >= BOTH_PARTS or whole >= WHOLE:
                old = found[doc].get(i, (0.0, 0.0, 0.0))
                new = score, len(question) / max(1, len(item.question)), len(answer) / max(1, len(item.answer))
                found[doc][i] = tuple(map(max, old, new))
        return found


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            units = units_of(text)
            terms = [(t, len(u)) for u in units for t in set(u)] + [("", len(u)) for u in units]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()), pa.array([n for _, n in terms], pa.int64())], ["term", "n_words"])


def build_indexes(benchmark: DataFrame, item_chars: int = ITEM_CHARS) -> Iterator[Index]:
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    counted = stored(items.select("text").mapInArrow(_terms, "term string, n_words long").groupBy("term").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words")))
    whole = counted.filter("term = ''").first()
    if whole is None:
        return
    chars = items.agg(F.sum(F.length("text"))).first()[0]
    parts = -(-chars // item_chars)
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        terms = own.select("text").mapInArrow(_terms, "term string, n_words long").select("term").distinct()
        frequency = {r.term: r.n for r in counted.join(terms, "term", "left_semi").collect()}
        rows = [(r.item_id, r.text) for r in own.distinct().collect()]
        if rows:
            yield Index(rows, frequency, whole.n, whole.n_words / whole.n)


def contamination(docs: DataFrame, benchmark: DataFrame, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the test items that documents hold."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    rows = id_and_text(docs)
    schema = f"doc_id long, item_id {kind.simpleString()}, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for number, index in enumerate(build_indexes(benchmark, item_chars)):
        found = rows.mapInArrow(_finder(spark.sparkContext.broadcast(index)), schema)
        out = found if number == 0 else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, item_chars: int = ITEM_CHARS) -> DataFrame:
    """The rows whose text holds no test item, with all their columns; null and empty texts hold none."""
    for index in build_indexes(benchmark, item_chars):
        docs = filtered(docs, "decontam", _no_item(docs.sparkSession.sparkContext.broadcast(index)))
    return docs


def _no_item(shared):
    return lambda: lambda texts: [not own for own in shared.value.contaminated([words_of(t) for t in texts])]


def _finder(shared):
    @lean("decontam")
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for ids, texts in rows_of(batch, binary=False):
                hits = index.contaminated([words_of(t) for t in texts])
                rows = [(ids[d], index.items[i].item_id, *v) for d, own in enumerate(hits) for i, v in sorted(own.items())]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap"), r)) for r in rows])

    return find
