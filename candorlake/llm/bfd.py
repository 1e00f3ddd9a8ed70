"""Best-fit-decreasing packing into id matrices, with a segment tree over the room left.

Each worker gathers documents up to WINDOW_IDS ids, sorts them by length, longest first, and puts each
into the fullest open row that still has room. The tree's leaves are the amounts of room 0..C, a node
holds whether any open row below it has that much, so the best fit is a walk of log2(C) steps. Rows
that stay emptier than CARRY go on to the next window, so memory is bounded and little is padded.

Documents over the capacity are split without loss: full rows first, the rest is packed like others.

Edge cases: a null or empty text is the end id alone; repeated rows and null ids are documents of
their own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from candorlake.llm.common import id_and_text, lean
from candorlake.llm.packing import Piece
from candorlake.llm.tokens import END_OF_DOCUMENT, default_tokenizer, encoded_documents

CAPACITY = 2048
#: Ids in a window, and the share of a row that may stay empty when a window ends.
WINDOW_IDS, CARRY = 4_000_000, 0.01
ROWS = "sequence_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
OUT_ROWS = 256


class RoomTree:
    """Open rows by the room that is left in them; ``take`` finds the least room that suffices."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._has = bytearray(2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        if not self._rows[room]:
            node = room + self._leaves
            while node and not self._has[node]:
                self._has[node] = 1
                node >>= 1
        self._rows[room].append(row)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a best fit, taken out of the tree, or None."""
        has, node = self._has, need + self._leaves
        if not has[node]:
            while True:  # up to the first ancestor with something to the right
                if node <= 1:
                    return None
                if not node & 1 and has[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self._leaves:
                node = 2 * node if has[2 * node] else 2 * node + 1
        room = node - self._leaves
        row = self._rows[room].pop()
        if not self._rows[room]:
            has[node] = 0
            node >>= 1
            while node and not (has[2 * node] or has[2 * node + 1]):
                has[node] = 0
                node >>= 1
        return room, row


def best_fit_rows(documents: Iterable[tuple[int | None, bytes]], capacity: int = CAPACITY, window_ids: int = WINDOW_IDS) -> Iterator[list[Piece]]:
    """The pieces of each finished row."""
    window: list[Piece] = []
    open_rows: list[list[Piece]] = []
    held = 0
    for doc_id, ids in documents:
        piece = Piece(doc_id, 0, len(ids) // 4, ids)
        while piece.length >= capacity:
            head, piece = piece.cut(capacity)
            yield [head]
        if piece.length:
            window.append(piece)
            held += piece.length
        if held >= window_ids:
            rows = _fit(window, open_rows, capacity)
            keep = [r for r in rows if capacity - sum(p.length for p in r) > CARRY * capacity]
            if 2 * sum(p.length for r in keep for p in r) > window_ids:  # hardly fillable: no use in carrying them
                keep = []
            kept = {id(r) for r in keep}
            yield from (r for r in rows if id(r) not in kept)
            window, open_rows, held = [], keep, sum(p.length for r in keep for p in r)
    yield from _fit(window, open_rows, capacity)


def _fit(window: list[Piece], rows: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    tree = RoomTree(capacity)
    for i, row in enumerate(rows):
        tree.add(capacity - sum(p.length for p in row), i)
    for piece in sorted(window, key=lambda p: -p.length):
        found = tree.take(piece.length)
        if found is None:
            rows.append([])
            found = capacity, len(rows) - 1
        room, row = found
        rows[row].append(piece)
        tree.add(room - piece.length, row)
    return rows


def pack_matrices(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_OF_DOCUMENT, pad_id: int = 0) -> DataFrame:
    """One row a packed sequence.

    input_ids: ``capacity`` little-endian 32-bit ids, padded with ``pad_id``; n_tokens of them count.
    cu_seqlens: 0 and the running end of each segment, as variable-length attention takes them.
    position_ids: little-endian 16-bit positions (capacity is at most 65,536), from 0 again at each
    segment, 0 in the padding. doc_ids, doc_starts: the document of each segment and the number of its
    ids before it.
    """
    if not 0 < capacity <= 65_536:
        raise ValueError("capacity must be from 1 to 65,536")
    path = tokenizer_path or default_tokenizer()

    @lean("tokens")
    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        ramp = np.arange(capacity, dtype="<u2").tobytes()
        pad = np.asarray([pad_id], dtype="<u4").tobytes()
        out: list[tuple] = []
        for number, pieces in enumerate(best_fit_rows(encoded_documents(batches, path, end_id), capacity)):
            lengths = [p.length for p in pieces]
            ends = np.cumsum([0, *lengths]).tolist()
            room = capacity - ends[-1]
            ids = b"".join([p.ids for p in pieces]) + pad * room
            positions = b"".join([ramp[: 2 * n] for n in lengths]) + bytes(2 * room)
            out.append((first + number, ends[-1], [p.doc_id for p in pieces], [p.start for p in pieces], ends, ids, positions))
            if len(out) >= OUT_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return id_and_text(docs).mapInArrow(pack_part, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for k, c in zip(kinds, zip(*rows))], [c.split()[0] for c in ROWS.split(", ")])


def write_matrices(packed: DataFrame, path: str) -> None:
    """Parquet files of packed rows; 1024 rows of a column chunk keep a reader's memory small."""
    packed.write.option("parquet.block.size", 32 << 20).mode("overwrite").parquet(path)
