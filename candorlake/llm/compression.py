"""Quality by compression: how much smaller a text gets with a dictionary of good text than of bad.

Two zstandard dictionaries are trained on pieces of labelled texts. A whole text is compressed with each; the
difference of the sizes, divided by the text's own, is close to 0 for text like neither and grows with the
likeness to one. Frame headers are left out of the sizes. A logistic curve makes the difference a probability
of label 1. It is fitted to other labelled texts than those in the dictionaries: whole ones, as they are scored.
What a dictionary saves is worth less the longer a text is, so the curve's slope and offset depend on the
length: their values at KNOTS lengths are fitted, with straight lines between them in the logarithm.

Training takes at most 2 * PER_CLASS documents of each label, those with the smallest hash of their id, and of
each up to WHOLE characters; the driver holds 4 * PER_CLASS * WHOLE characters at most. Dictionaries are made of
PIECES pieces of PIECE characters evenly spread over each. Language, source and id are never inputs of a score;
a hash of the id deals the training texts to the two halves.

Edge cases: null text counts as empty and is scored like one; an empty text has a difference of 0 and the
score that follows from it; a text of any length is compressed whole; without labels of both kinds all get the share of label 1, or 0.5; rows
labelled twice count by their smaller label; repeated rows and null ids are rows like others (never held
out); an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorlake.llm.common import bucket, id_and_text, lean, lowest_hashes, rows_of

PER_CLASS = 600
PIECES, PIECE, WHOLE = 3, 2000, 20_000
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: Bytes of a frame's headers, as far as they are alike for every text.
HEADER = 6
#: Lengths in bytes at which the curve is fitted.
KNOTS = (40, 160, 640, 2560, 10_240)
RIDGE = 0.05
THRESHOLD = 0.3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    scale: float
    weights: np.ndarray
    prior: float


class _Compressor:
    def __init__(self, dictionary: bytes):
        own = zstandard.ZstdCompressionDict(dictionary)
        own.precompute_compress(level=LEVEL)
        self._z = zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: bytes) -> int:
        return len(self._z.compress(text)) - HEADER


def differences(good: _Compressor, bad: _Compressor, texts: list[bytes | None]) -> np.ndarray:
    """(normalised difference, log length) of each text; 0 and 0 for an empty one."""
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        if text:
            a, b = good.size(text), bad.size(text)
            out[i] = (b - a) / len(text), np.log(len(text))
    return out


def _inputs(x: np.ndarray, scale: float) -> np.ndarray:
    """Of the curve: for each knot its share of the length, and this share times the difference."""
    knots = np.log(KNOTS)
    place = np.clip(np.interp(x[:, 1], knots, np.arange(len(knots))), 0, len(knots) - 1)
    share = np.maximum(0, 1 - np.abs(place[:, None] - np.arange(len(knots))))
    return np.column_stack([share, share * (x[:, :1] / scale)])


def _scores(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(x, model.scale) @ model.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's steps with a light ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one row for each labelled id."""
    return labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))


def sample(docs: DataFrame, known: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, int, str]]:
    """(doc_id, label, text) of a bounded sample of rows (doc_id, label); of a longer text up to WHOLE characters.

    Of rows that share an id one is taken."""
    chosen = lowest_hashes(known, "label", 2 * per_class)
    rows = id_and_text(docs).filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.substring("text", 1, WHOLE).alias("text"))
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return sorted((r.doc_id, r.label, r.text) for r in rows.collect())


def _pieces(text: str) -> list[bytes]:
    """Up to PIECES pieces of PIECE characters, evenly spread."""
    end = max(0, len(text) - PIECE)
    starts = dict.fromkeys(round(end * i / max(1, PIECES - 1)) for i in range(PIECES))
    return [text[a : a + PIECE].encode("utf-8") for a in starts]


def _dictionary(pieces: list[bytes]) -> bytes:
    """Trained where there is enough text for it, else the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def train(rows: list[tuple[int, int, str]], share: float | None = None) -> Model:
    """rows: (id, label, text). One half makes the dictionaries, the other the curve; the id only tells the halves.

    share: of label 1 among all labels, to which the curve is moved where the sample has another.
    """
    half = lambda r: zlib.crc32(f"half {r[0]}".encode()) % 2
    own = float(np.mean([r[1] for r in rows])) if rows else 0.5
    share = own if share is None else share
    none = Model(b"", b"", 1.0, np.zeros(2 * len(KNOTS)), share)
    texts = {label: [p for r in rows if r[1] == label and half(r) == 0 for p in _pieces(r[2])] for label in (0, 1)}
    rest = [r for r in rows if half(r) == 1]
    if not all(texts.values()) or len({r[1] for r in rest}) < 2:
        return none
    good, bad = _dictionary(texts[1]), _dictionary(texts[0])
    # Texts as they are, and their beginnings, so that short texts are met as often as long ones.
    parts = [p for r in rest for p in (r[2], *(r[2][:n] for n in KNOTS[:-1] if n < len(r[2])))]
    y = np.array([r[1] for r in rest for p in (0, *(n for n in KNOTS[:-1] if n < len(r[2])))], dtype=float)
    x = differences(_Compressor(good), _Compressor(bad), [p.encode("utf-8") for p in parts])
    scale = float(x[:, 0].std()) + 1e-9
    weights = _logistic(_inputs(x, scale), y, RIDGE)
    weights[: len(KNOTS)] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(good, bad, scale, weights, share)


def _scorer(shared):
    @lean("compression")
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pair = (_Compressor(model.good), _Compressor(model.bad)) if model.good else None
        for batch in batches:
            for ids, texts in rows_of(batch):
                p = _scores(model, differences(*pair, texts)) if pair else np.full(len(ids), model.prior)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p, pa.float64())], ["doc_id", "score"])

    return score


def held_out(parts: int = 5) -> Column:
    return F.coalesce(bucket("doc_id", parts) == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; trains on labels that aren't held out unless
    given a model."""
    if model is None:
        known = labelled(labels).filter(~held_out())
        model = train(sample(docs, known), known.agg(F.avg("label")).first()[0])
    found = id_and_text(docs).mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
