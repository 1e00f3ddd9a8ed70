"""What span-finding operators share: the span type, their tables and redaction.

Offsets are code points of the text, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorlake.llm.common import id_and_text, lean, rows_of

SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, probability: double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())]))


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool = True
    probability: float = 1.0


Finder = Callable[[list[str]], list[list[Span]]]


def find_spans(docs: DataFrame, make: Callable[[], Finder]) -> DataFrame:
    """(doc_id, spans) for each row; make: builds the finder once a task."""

    @lean("spans")
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = make()
        for batch in batches:
            for ids, texts in rows_of(batch, binary=False):
                found = finder([t or "" for t in texts])
                spans = pa.array([[s._asdict() for s in own] for own in found], _ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), spans], ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(find, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, make: Callable[[], Finder], mask: str = "[{}]") -> DataFrame:
    """The rows with the spans of their text replaced by a mask that names the kind; a null text stays.

    All columns stay in place. A length in n_chars, where there is one, follows the text.
    """
    names = docs.columns
    place = names.index("text")

    @lean("spans")
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = make()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            out = []
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                out += [t if t is None or not own else masked(t, own, mask) for t, own in zip(part, finder([t or "" for t in part]))]
            columns = list(batch.columns)
            columns[place] = pa.array(out, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(change, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def masked(text: str, spans: list[Span], mask: str) -> str:
    """The text with spans replaced; of overlapping ones, the union under the first one's kind."""
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= last:
            out += [text[last : s.start], mask.format(s.kind)]
        last = max(last, s.end)
    return "".join([*out, text[last:]])


def disjoint(fixed: list[Span], more: list[Span]) -> list[Span]:
    """Of more, likeliest first, those that overlap neither the fixed ones nor each other."""
    if not more:
        return []
    taken = bytearray(max(s.end for s in (*fixed, *more)))
    for s in fixed:
        taken[s.start : s.end] = b"\1" * (s.end - s.start)
    out = []
    for s in sorted(more, key=lambda s: (-s.probability, s.start, -s.end, s.kind)):
        if taken.find(1, s.start, s.end) < 0:
            taken[s.start : s.end] = b"\1" * (s.end - s.start)
            out.append(s)
    return out


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
