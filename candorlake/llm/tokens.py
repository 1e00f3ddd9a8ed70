"""Token ids of whole texts by a public tokenizer file.

The tokenizer lower-cases, drops white space and never merges across it, so a text's ids are the ids of
its white-space separated chunks, one after the other. Arrow splits many texts at once and numbers their
distinct chunks; only those become Python objects. A bounded memo of word -> ids, kept for the life of a
worker, spares most of them the tokenizer; then numpy copies the ids to where they belong.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from candorlake.llm.common import keeps, lean, rows_of

#: Entries of each of the memo's two generations (about 200 bytes each), and the longest word that it keeps.
MEMO_ENTRIES, MEMO_LETTERS = 200_000, 48
#: Bytes of text that are taken at a time; a longer text is taken alone.
PART_BYTES = 2 << 20
END_OF_DOCUMENT = 2
#: Letters that are in normal form and whose lower case is one letter of the same kind; then marks.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]{1,48})([!#$%&*.,:;?|]{0,8})")
#: How byte-level models spell bytes: printable ones as themselves, the rest from U+0100 on, in order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELLING = {b: 0x100 + i for i, b in enumerate(sorted({*range(256)} - _PRINTABLE))}
_PACKED = struct.Struct("<I").pack


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """Little-endian unsigned 32-bit ids of texts, equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share out
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        special = {t.content: i for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self._mark, self._mark_id = next(reversed(special.items()), (None, None))
        self._plain = self._encode_alone("Éàz") == b"".join([_PACKED(t.id) for t in self._tokenizer.model.tokenize("éàz".encode("utf-8").decode("latin-1").translate(_SPELLING))])
        self._starts = sorted({s[:2] for s in special})

    def _encode_alone(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode_together(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks encoded as one text with a special token between them, which costs a fraction of a call
        for each."""
        mark = self._mark
        out = {c: self._encode_alone(c) for c in chunks if mark is None or mark in c}
        rest = [c for c in chunks if c not in out]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            encoded = self._tokenizer.encode_batch_fast([f" {mark} ".join(part)], add_special_tokens=False)
            ids = np.asarray(encoded[0].ids, dtype="<u4")
            cuts = [-1, *np.flatnonzero(ids == self._mark_id).tolist(), len(ids)]
            data = ids.tobytes()
            out.update((c, data[4 * i + 4 : 4 * j]) for c, i, j in zip(part, cuts, cuts[1:]))
        return out

    def _word(self, word: str) -> bytes:
        """Ids of a run of plain letters, or of plain marks: one word to the tokenizer, already in its
        normal form but for its case. It goes to the merge model at once."""
        ids = self._young.get(word)
        if ids is None:
            ids = self._old.get(word)
            if ids is None:
                low = word.lower()
                spelled = low if low.isascii() else low.encode("utf-8").decode("latin-1").translate(_SPELLING)
                ids = b"".join([_PACKED(t.id) for t in self._tokenizer.model.tokenize(spelled)])
            self._young[word] = ids
        return ids

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        if len(self._young) > MEMO_ENTRIES:
            self._old, self._young = self._young, {}
        young, old, word = self._young, self._old, self._word
        out = list(map(young.get, chunks))
        other = []
        plain = _PLAIN.fullmatch if self._plain else lambda text: None
        for i in [i for i, ids in enumerate(out) if ids is None]:
            chunk = chunks[i]
            ids = old.get(chunk)
            if ids is None:
                found = plain(chunk)
                if found is None:
                    other.append((i, chunk))
                    continue
                letters, marks = found.groups()
                ids = word(letters) + word(marks) if marks else word(letters)
            out[i] = young[chunk] = ids
        if other:
            known = self._encode_together(list({c for _, c in other}))
            for at, chunk in other:
                out[at] = known[chunk]
            young.update((c, i) for c, i in known.items() if len(c) <= MEMO_LETTERS)
        return out

    def encode_part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end) for an array of strings; null counts as empty."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        for start in self._starts:  # where there may be a special token, case matters
            low = pc.if_else(pc.match_substring(texts, start), texts, low)
        lists = pc.ascii_split_whitespace(low)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        numbered = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        ids = self._ids_of(numbered.dictionary.to_pylist())
        if not ids:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        data = np.frombuffer(b"".join(ids), dtype="<u4")
        which = numbered.indices.to_numpy()
        own = lengths[which]
        ends = np.append(0, np.cumsum(own))
        at = np.repeat((np.cumsum(lengths) - lengths)[which] - ends[:-1], own)
        at += np.arange(ends[-1])
        return data[at], ends[offsets - offsets[0]]

    def encode_array(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, in parts of about PART_BYTES."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), PART_BYTES)))
            ids, bounds = self.encode_part(texts.slice(at, end - at))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield ids[a:b].tobytes()
            at = end

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return list(self.encode_array(pa.array(texts, pa.string())))


@lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer with its memo for all tasks of a Python worker."""
    return ChunkTokenizer(path)


keeps("tokens", worker_tokenizer.cache_clear)


def encoded_documents(batches: Iterable[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) for each row of Arrow batches of (doc_id, text), in their order."""
    tokenizer = worker_tokenizer(path)
    end = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_array(batch.column(1))):
            yield doc_id, ids + end


def token_counts(docs: DataFrame, keys: tuple[str, ...] = (), tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, the string columns ``keys``, n_words, n_tokens) for each row; a null text has none of either.

    Words are stretches without ASCII white space.
    """
    path = tokenizer_path or default_tokenizer()
    names = ["doc_id", *keys, "n_words", "n_tokens"]

    @lean("tokens")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for _, texts in rows_of(batch):
                words += [len((t or b"").split()) for t in texts]
            tokens = [len(ids) // 4 for ids in worker_tokenizer(path).encode_array(batch.column(1))]
            own = [batch.column(0), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[k].cast("string").alias(k) for k in keys])
    return rows.mapInArrow(count, "doc_id long, " + "".join(f"`{k}` string, " for k in keys) + "n_words long, n_tokens long")
