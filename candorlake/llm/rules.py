"""Quality rules by distribution divergence, in DataFrame functions alone.

A text is compared with a language's reference in two histograms: its characters by class, and its words
by common word (all others in one bin). The measure is the Jensen-Shannon distance, the square root of
the divergence in bits, from 0 to 1. Every language of the table that has LEAST_TEXTS texts or more has a
reference: its COMMON most frequent words and the summed counts of all its texts. Words are counted by
language in one pass with partial sums, character classes in another; a few numbers a language reach the driver,
whatever the number of texts. A text is judged by the language whose common words it is closest to. A short
text's histogram is mostly chance: below LEAST_CHARS or LEAST_WORDS the histogram isn't judged, and the limits
widen with one over the root of the length.

Before that come rules on length and repetition. Runs of eight words that occur twice are found inside
the row: hashes of the runs are only sorted where some hash occurs twice.

Edge cases: null text counts as empty, has no words and fails; a text of any length is judged whole;
repeated rows and null ids are rows like others; of equally frequent words the first in order is common, of
equally close languages the first by name is taken; without a language of enough texts there is no reference and
the distances are null and pass; an empty table gives an empty result; other columns, of whatever name, are
ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candorlake.llm.common import stored

#: Words that a language is told by, and the least number of texts of a language that has a reference.
COMMON, LEAST_TEXTS = 20, 20
#: Character classes that are counted by pattern. The histogram is one of bytes: these, white
#: space, symbols, the bytes that continue a character beyond ASCII, and the rest (mostly small letters).
CLASSES = {"upper": r"[A-Z]+", "digit": r"[0-9]+", "stop": r"[.,;:!?'\"()-]+"}
SYMBOLS = r"[#*$%&|<>]+"
_SPLIT = r"[\x20\x09-\x0D]+"
RUN = 8
LEAST_BASE_WORDS, REPEATED_PERCENT = 20, 30
LEAST_CHARS, LEAST_WORDS = 60, 25
#: Largest distances for a text of endless length, and what is added for each over the root of its length.
CHAR_LIMIT, CHAR_CHANCE = 0.15, 2.5
WORD_LIMIT, WORD_CHANCE = 0.15, 1.3


def _number_of(text: Column, pattern: str) -> Column:
    """Characters in matches of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text, words) of every row; null text as empty."""
    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("words", F.filter(F.split("text", _SPLIT), lambda w: w != ""))


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """The most frequent words of each language with enough texts, by name and in order of the words."""
    rows = _rows(docs).filter(F.col("lang").isNotNull() & (F.size("words") > 0))
    languages = rows.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TEXTS).select("lang")
    counted = rows.join(F.broadcast(languages), "lang", "left_semi").select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= COMMON)  # tasks rank their own words first
    found = best.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("words"))
    return {r.lang: list(r.words) for r in sorted(found.collect())}


def _histograms(rows: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, chars (counts by class) and counts (of the languages' common words)."""
    text = F.col("text")
    every = sorted({w for words in common.values() for w in words})
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_chars_": F.length(text),
        "n_bytes_": F.octet_length(text),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": _number_of(text, SYMBOLS).cast("long"),
        "of_class": F.array(*[_number_of(text, p).cast("long") for p in CLASSES.values()]),
        "known": F.filter("words", lambda w: w.isin(every) if every else F.lit(False)),
    })
    further = [F.col("n_chars_") - F.col("word_chars"), F.col("n_symbols"), (F.col("n_bytes_") - F.col("n_chars_")).cast("long")]
    counted = sum([F.col("of_class")[i] for i in range(len(CLASSES))], sum(further, F.lit(0)))
    rows = rows.withColumn("chars", F.concat("of_class", F.array(*further, F.col("n_bytes_") - counted)))
    # Counts by word: the common words sorted, and where each one's stretch begins.
    rows = rows.withColumn("sorted", F.sort_array("known"))
    first = F.transform("sorted", lambda w, i: F.when((i == 0) | (F.get("sorted", i - 1) != w), F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("firsts", F.filter(first, lambda e: e.isNotNull()))
    until = lambda i: F.coalesce(F.get("firsts", i + 1)["i"], F.size("sorted"))
    return rows.withColumn("counts", F.map_from_arrays(F.transform("firsts", lambda e: e["w"]), F.transform("firsts", lambda e, i: until(i) - e["i"])))


def profiles(docs: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """One row a document: all that its text is judged by, and its language."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = _histograms(_rows(docs), common).withColumn("lines", lines)
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    kept = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_chars_", "n_bytes_", "chars", "counts"]
    return _repeats(rows.select(*kept, "words")).select(*kept, "n_repeat_words")


class Reference(NamedTuple):
    """Of a language: shares of byte classes; its common words, their shares, and that of all other words."""

    lang: str
    chars: list[float]
    words: list[str]
    shares: list[float]
    rest: float


def references(rows: DataFrame, common: dict[str, list[str]]) -> list[Reference]:
    """The references of the languages of common, from profiles."""
    size = len(CLASSES) + 4
    rows = rows.filter(F.col("lang").isin(list(common)))
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(size)]
    of_lang = {r.lang: r for r in rows.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect()}
    of_word = {(r.lang, r.key): r.n for r in rows.select("lang", F.explode("counts")).groupBy("lang", "key").agg(F.sum("value").alias("n")).collect()}
    out = []
    for name, words in common.items():
        r = of_lang.get(name)
        if r and r.n:
            chars = [r[f"c{i}"] for i in range(size)]
            shares = [of_word.get((name, w), 0) / r.n for w in words]
            out.append(Reference(name, [c / sum(chars) for c in chars], words, shares, (r.n - sum(of_word.get((name, w), 0) for w in words)) / r.n))
    return out


def _distance(shares: Column, reference: Column) -> Column:
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(shares, reference, lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in runs of RUN words that the text has twice or more."""
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    at = lambda i, j: F.get("hashes", i + j)
    runs = F.transform(F.sequence(F.lit(0), F.size("hashes") - RUN), lambda i: F.xxhash64(*[at(i, j) for j in range(RUN)]))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("runs", F.when(F.size("hashes") > RUN, runs).otherwise(none))
    rows = rows.withColumn("repeated", F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.col("runs")).otherwise(none))
    rows = rows.withColumn("ranked", F.sort_array(F.transform("repeated", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda e, k: F.coalesce(F.get("ranked", k)["h"] == e["h"], F.lit(False))
    marked = F.transform("ranked", lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
    rows = rows.withColumn("starts", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).alias("n"), F.lit(-RUN).alias("last"))
    step = lambda s, i: F.struct((s["n"] + F.least(F.lit(RUN), i - s["last"])).alias("n"), i.alias("last"))
    return rows.withColumn("n_repeat_words", F.aggregate("starts", start, step)["n"].cast("long"))


def judge(docs: DataFrame, known: list[Reference] | None = None) -> DataFrame:
    """One row a document: the counts, base_failed, the distances from the closest language, kept."""
    common = common_words(docs) if known is None else {r.lang: r.words for r in known}
    rows = stored(profiles(docs, common))
    known = references(rows, common) if known is None else known
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("n_bytes_", F.lit(1))
    rows = rows.withColumn("char_shares", F.transform("chars", lambda x: x / chars))
    if known:
        kind = "array<struct<lang: string, chars: array<double>, words: array<string>, shares: array<double>, rest: double>>"
        made = docs.sparkSession.createDataFrame([([tuple(r) for r in known],)], f"refs {kind}")
        rows = rows.crossJoin(F.broadcast(made))  # one row

    def measured(ref: Column) -> Column:
        own = F.transform(ref["words"], lambda w: F.coalesce(F.try_element_at("counts", w), F.lit(0)))
        other = F.col("n_words") - F.aggregate(own, F.lit(0), lambda s, x: s + x)
        shares = F.transform(F.concat(own.cast("array<bigint>"), F.array(other)), lambda x: x / n)
        return F.struct(F.round(_distance(shares, F.concat(ref["shares"], F.array(ref["rest"]))), 12).alias("words"), ref["lang"].alias("lang"), _distance(F.col("char_shares"), ref["chars"]).alias("chars"))

    closest = F.array_min(F.transform("refs", measured)) if known else F.lit(None).cast("struct<words: double, lang: string, chars: double>")
    rows = rows.withColumn("closest", closest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_", F.col("closest.lang").alias("closest_lang"), F.col("closest.chars").alias("char_distance"), F.col("closest.words").alias("word_distance"))
    failed = (F.col("n_words") < LEAST_BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    odd_chars = (F.col("n_chars_") >= LEAST_CHARS) & (F.col("char_distance") > CHAR_LIMIT + CHAR_CHANCE / F.sqrt(F.greatest("n_chars_", F.lit(1))))
    odd_words = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > WORD_LIMIT + WORD_CHANCE / F.sqrt(n))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(odd_chars, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))).alias("kept"), "closest_lang", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
