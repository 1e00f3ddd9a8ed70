"""Harmonic packing of documents into fixed-length training sequences.

Class k holds lengths of at most C/k and more than C/(k+1); k of them always fit one sequence, so a
sequence of class k is filled with exactly k pieces, without a search and without a word between
workers. A plain harmonic packer leaves up to half of a class-1 sequence empty. As cuts are free, a
length that would waste more than SLACK of itself is cut at C/(k+1), the top of the next class, and the
rest goes on to a class of at least k(k+1): after three such cuts at most nothing notable is left
over. What a worker's unfinished sequences hold at its end is laid end to end and cut at C; the
last, short stretch is cut into sequences of power-of-two lengths, which need no padding.

Each worker keeps one unfinished sequence a class (some 130 at most, 2 MB), never a group of rows,
and nothing is shuffled.

Edge cases: a null or empty text is a document of the end id alone; repeated rows and repeated or
null ids are documents of their own; a text of any length is cut into full sequences and a rest;
an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from candorlake.llm.common import id_and_text, lean
from candorlake.llm.tokens import END_OF_DOCUMENT, default_tokenizer, encoded_documents

CAPACITY = 4096
#: A piece stays whole if its share of its sequence's padding is at most this part of its length.
SLACK = 1 / 64
#: Rows of an output batch, and bytes of ids after which one is sent early.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, class long, ids binary"


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple["Piece", "Piece"]:
        return self._replace(ids=self.ids[: 4 * at]), self._replace(start=self.start + at, ids=self.ids[4 * at :])


def harmonic_cut(piece: Piece, capacity: int = CAPACITY) -> Iterator[tuple[int, Piece]]:
    """(class, piece) for the pieces of a document."""
    while piece.length > capacity:
        head, piece = piece.cut(capacity)
        yield 1, head
    while True:
        n = piece.length
        k = capacity // n
        if capacity - k * n <= SLACK * k * n:
            yield k, piece
            return
        head, piece = piece.cut(capacity // (k + 1))
        yield k + 1, head


def harmonic_bins(documents: Iterable[tuple[int | None, bytes]], capacity: int = CAPACITY) -> Iterator[tuple[int, list[Piece]]]:
    """(class, pieces) of finished sequences; class 0 for those made of leftovers."""
    unfinished: dict[int, list[Piece]] = {}
    for doc_id, ids in documents:
        if not ids:
            continue
        for k, piece in harmonic_cut(Piece(doc_id, 0, len(ids) // 4, ids), capacity):
            if k == 1:
                yield 1, [piece]
                continue
            pieces = unfinished.setdefault(k, [])
            pieces.append(piece)
            if len(pieces) == k:
                del unfinished[k]
                yield k, pieces
    yield from ((0, pieces) for pieces in _laid_end_to_end([p for k in sorted(unfinished) for p in unfinished[k]], capacity))


def _laid_end_to_end(pieces: list[Piece], capacity: int) -> Iterator[list[Piece]]:
    total = sum(p.length for p in pieces)
    sizes = [capacity] * (total // capacity)
    rest = total % capacity
    sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    queue = iter(pieces)
    piece = next(queue, None)
    for size in sizes:
        row: list[Piece] = []
        while size:
            if piece.length > size:
                head, piece = piece.cut(size)
            else:
                head, piece = piece, next(queue, None)
            row.append(head)
            size -= head.length
        yield row


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_OF_DOCUMENT) -> DataFrame:
    """One row a piece, with its ids as little-endian unsigned 32-bit numbers.

    doc_id; start and length in the document's ids; doc_tokens; sequence_id and offset there; class
    (0: made of leftovers). Sequences are to be padded to ``capacity``, except at a power of two.
    """
    path = tokenizer_path or default_tokenizer()

    @lean("tokens")
    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        size = 0
        for number, (k, pieces) in enumerate(harmonic_bins(encoded_documents(batches, path, end_id), capacity)):
            offset = 0
            for p in pieces:
                rows.append((p.doc_id, p.start, p.length, p.doc_tokens, first + number, offset, k, p.ids))
                offset += p.length
            size += 4 * offset
            if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return id_and_text(docs).mapInArrow(pack_part, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))], names)
