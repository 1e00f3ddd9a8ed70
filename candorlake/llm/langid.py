"""Language identification by a byte-level convolutional network, trained and applied in numpy.

Filters of several widths slide over windows of WINDOW bytes; the largest value of each is a feature, and
a softmax layer turns the features into probabilities of languages (see bytenet). A text, lower-cased, is cut into
windows that together cover all of it; the mean of their probabilities, by length, decides.

Training takes at most DOCS_PER_LANGUAGE documents of each language, those with the smallest hash
of their id, and WINDOWS_PER_DOCUMENT windows evenly spread over each that has a letter; the driver holds a few MB. Of rows that share id and language one is taken.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text shorter than a window
is filled up with spaces; without any labelled text all are ``und``; repeated rows and null ids are rows
like others (never held out); of equally likely languages the first by name is taken; a very long text is taken
window by window; an empty table gives an empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candorlake.llm.bytenet import Network, Scorer, fit
from candorlake.llm.common import bucket, filtered, id_and_text, lean, lowest_hashes, rows_of

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 8
DOCS_PER_LANGUAGE, WINDOWS_PER_DOCUMENT = 400, 4
EPOCHS = 8
SHORTEST = 8
UNKNOWN = "und"
#: Letters, and numerals that are no digits.
_LETTERLIKE = re.compile(r"[^\W\d_]")


class Identifier(NamedTuple):
    languages: list[str]
    network: Network


def train(texts: list[str], languages: list[str]) -> Identifier | None:
    """texts: windows of text; shorter crops of them are drawn anew for each epoch."""
    names = sorted(set(languages))
    if not names:
        return None
    data = [_bytes(t)[:WINDOW] for t in texts]

    def crops(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        x = np.full((len(rows), WINDOW), 32, dtype=np.uint8)
        for i, r in enumerate(rows):
            n = min(len(data[r]), int(np.exp(rng.uniform(np.log(SHORTEST), np.log(WINDOW + 1)))))
            start = rng.integers(0, len(data[r]) - n + 1)
            x[i, :n] = data[r][start : start + n]
        return x

    labels = np.array([names.index(x) for x in languages])
    return Identifier(names, fit(crops, labels, len(names), WIDTHS, FILTERS, EPOCHS))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8"), dtype=np.uint8)


def training_windows(docs: DataFrame, learn: Column, per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Windows of text and their languages, from a bounded sample of the rows where ``learn`` holds."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = lowest_hashes(rows.select("doc_id", "lang"), "lang", per_language)
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    ends = F.greatest(F.length("text") - WINDOW, F.lit(0))
    pieces = [F.substring("text", (ends * (i / max(1, WINDOWS_PER_DOCUMENT - 1))).cast("int") + 1, F.lit(WINDOW)) for i in range(WINDOWS_PER_DOCUMENT)]
    own = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min(F.array_distinct(F.array(*pieces))).alias("pieces"))
    found = own.select("lang", "doc_id", F.explode("pieces").alias("piece"))
    found = sorted((r.lang, r.doc_id, r.piece) for r in found.collect())
    return [r[2] for r in found], [r[0] for r in found]


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter in the sense of Unicode: numerals such as one half are none."""
    return bool(text) and any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


def languages_of(net: Identifier | None):
    """A function from texts to (languages, scores)."""
    scorer = net and Scorer(net.network)

    def tell(texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if scorer and has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        windows, owner, weight = [], [], []
        total = np.zeros((len(texts), len(net.languages) if net else 0))

        def settle():
            if windows:
                x, shares = np.concatenate(windows), np.concatenate(weight)
                own = np.repeat(owner, [len(w) for w in windows])
                for at in range(0, len(x), 64):
                    p = scorer.probabilities(x[at : at + 64])
                    np.add.at(total, own[at : at + 64], p * shares[at : at + 64, None])
            windows.clear(), owner.clear(), weight.clear()

        held = 0
        for i in known:
            b = _bytes(texts[i])
            n = -(-len(b) // WINDOW)
            x = np.full(n * WINDOW, 32, dtype=np.uint8)
            x[: len(b)] = b
            windows.append(x.reshape(n, WINDOW))
            owner.append(i)
            share = np.full(n, WINDOW / len(b))
            share[-1] = (len(b) - WINDOW * (n - 1)) / len(b)
            weight.append(share)
            held += n
            if held >= 1024:
                settle()
                held = 0
        settle()
        for i in known:
            best = int(total[i].argmax())
            names[i], scores[i] = net.languages[best], min(1.0, float(total[i][best]))
        return names, scores

    return tell


def _predictor(net: Identifier | None):
    @lean("langid")
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = languages_of(net)
        for batch in batches:
            for ids, texts in rows_of(batch, binary=False):
                names, scores = tell(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def held_out(parts: int = 4, which: int = 2) -> Column:
    return F.coalesce(bucket("doc_id", parts) == which, F.lit(False))


def of_known_language(docs: DataFrame, least: float, network: Identifier | None = None) -> DataFrame:
    """The rows whose text has a language with a score of ``least`` or more, with all their columns."""
    if network is None:
        network = train(*training_windows(docs, ~held_out()))

    def make():
        tell = languages_of(network)
        return lambda texts: [n != UNKNOWN and s >= least for n, s in zip(*tell(texts))]

    return filtered(docs, "langid", make)


def identify(docs: DataFrame, network: Identifier | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; trains on the rows that aren't held out unless
    given a network."""
    if network is None:
        network = train(*training_windows(docs, ~held_out()))
    found = id_and_text(docs).mapInArrow(_predictor(network), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
