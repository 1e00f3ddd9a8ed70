"""Classifiers on held-out rows, rules against SQL and brute force, and odd rows for each."""

import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from candorlake.llm import compression, langid, oracles, rules
from candorlake.llm.shingles import shingle_sets
from parity import connect, differences


def test_languages(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


def test_languages_of_odd_rows(docs, odd, empty):
    model = langid.train(*langid.training_windows(docs, ~langid.held_out(), per_language=60))
    got = Counter((r.doc_id, r.lang_pred == "und") for r in langid.identify(odd, model).collect())
    assert got == Counter((r.doc_id, r.doc_id in (1, 2, 3, 10)) for r in odd.collect())
    assert {r.lang_pred for r in langid.identify(odd).collect()} <= {"und", "en", "la", "xx"}
    assert langid.identify(empty).collect() == []
    assert {r.lang_pred for r in langid.identify(odd.filter("lang IS NULL")).collect()} == {"und"}


def test_scores_equal_a_plain_forward_pass(docs):
    """The lookup tables against sums written out, on whole texts of one window and of several."""
    net = langid.train(*langid.training_windows(docs, ~langid.held_out(), per_language=20))
    texts = [r.text for r in docs.limit(12).collect()] + ["ein kurzer satz", "x"]
    names, scores = langid.languages_of(net)(texts)
    n = net.network
    for text, name, score in zip(texts, names, scores):
        data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
        total = np.zeros(len(net.languages))
        for at in range(0, len(data), langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            x = np.concatenate([part, np.full(langid.WINDOW - len(part), 32, dtype=np.uint8)])
            h = []
            for w in n.weights:
                h += [max(sum(float(w[j, x[i + j], k]) for j in range(len(w))) for i in range(len(x) - len(w) + 1)) for k in range(w.shape[2])]
            z = np.maximum(np.array(h) + n.bias, 0) @ n.dense + n.dense_bias
            p = np.exp(z - z.max())
            total += p / p.sum() * len(part) / len(data)
        assert net.languages[int(total.argmax())] == name and abs(total.max() - score) < 1e-4
        if len(data) > 3000:
            break


def test_letters():
    assert [langid.has_letter(t) for t in (None, "", "½", "² Ⅷ ①", "12 %", "a", "½ x", "中", "_é")] == [False, False, False, False, False, True, True, True, True]


def test_quality(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = compression.quality(docs, labels).join(labels, "doc_id").collect()
    out = sorted((r.score, r.quality) for r in rows if r.held_out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    right = sum((s >= 0.3) == (q == 1) for s, q in out) / len(out)
    assert right > 0.95
    assert abs(sum(good + bad) / len(out) - len(good) / len(out)) < 0.05  # calibrated in the large


def test_quality_of_odd_rows(spark, odd, empty, labels):
    few = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows = compression.quality(odd, few).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in compression.quality(odd, few.filter("false")).collect()} == {0.5}
    assert compression.quality(empty, labels).collect() == []
    docs = spark.createDataFrame([(i, ("good text about the world and its people " if i % 2 else "spam !!! buy now $$$ ") * 9) for i in range(80)], "doc_id long, text string")
    marked = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "0 AS toxic")
    model = compression.train(compression.sample(docs, compression.labelled(marked)))
    texts = [b"good text about the world", b"spam !!! buy now", None, b"", "é".encode() * 50]
    got = compression.differences(*(compression._Compressor(x) for x in (model.good, model.bad)), texts)
    for (d, n), t in zip(got, texts):  # by the library's plain calls
        sizes = [len(zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t or b"")) for x in (model.good, model.bad)]
        assert abs(d - ((sizes[1] - sizes[0]) / len(t) if t else 0)) < 1e-12
    assert got[0][0] > 0 > got[1][0] and got[2].tolist() == got[3].tolist() == [0, 0]
    scores = compression._scores(model, got)
    assert scores[0] > 0.5 > scores[1]
    got = compression.quality(odd, labels, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)


def test_rules_same_as_sql(spark, docs):
    assert differences(rules.judge(docs), oracles.QUALITY_RULES, connect("/root/testdata/sf0.01")) == []


def repeated(words):
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_rules_of_odd_rows(spark, odd, empty):
    more = [(20, "a b c d e f g h a b c d e f g h"), (21, "x " * 9), (22, "y\ny\n\n \nz\ny"), (23, "a b c d e f g h i " * 5 + "end #*$%&|<>")]
    table = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*m, "en") for m in more], "doc_id long, text string, lang string"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(table).collect())
    want = Counter()
    for r in table.collect():
        t = r.text or ""
        words = [w.decode() for w in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        rep = repeated(words)
        want[r.doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(words) < 20 or 100 * rep > 30 * len(words)] += 1
    assert got == want
    assert rules.judge(empty).collect() == []
    none = rules.judge(table.drop("lang")).collect()
    assert all(r.char_distance is None and r.kept == (not r.base_failed) for r in none)


def test_rules_are_native(docs):
    common = {"en": ["of", "the"], "de": ["der", "die"]}
    known = [rules.Reference("en", [1 / 7] * 7, ["of", "the"], [0.1, 0.1], 0.8)]
    for df in (rules.profiles(docs, common), rules.judge(docs, known)):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_rules_know_every_language_of_the_table(spark, docs):
    """A language that nobody listed is told by its own words, and its documents stay."""
    import random

    r = random.Random(3)
    stop, rest = ["ja", "on", "ei", "se", "hän", "oli", "kun", "niin"], [f"{a}{b}{c}nen" for a in ("kau", "tal", "met", "jär") for b in ("pu", "vi", "sä", "lo") for c in ("ki", "la", "mi", "")]
    fifth = [(10**9 + i, " ".join(r.choice(stop if r.random() < 0.4 else rest) for _ in range(150)), "fi") for i in range(60)]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(fifth, "doc_id long, text string, lang string"))
    got = rules.judge(table).filter("doc_id >= 1000000000").collect()
    assert len(got) == 60 and all(x.kept and x.closest_lang == "fi" for x in got)
    assert set(rules.common_words(table)["fi"]) >= set(stop) and set(rules.common_words(table)) == {"de", "en", "es", "fi", "fr"}


def test_shingles():
    assert [len(s) for s in shingle_sets([None, b"", b"a", b"A b", b"a b c d e f", b" \n"])] == [0, 0, 1, 1, 2, 0]
    a, b = shingle_sets([b"A b c d e", b"a\tB\nc d  e"])
    assert a.tolist() == b.tolist()


@pytest.mark.parametrize("text", ["a b c d", "a b c d e"])
def test_short_sets_differ_from_longer_ones(text):
    a, b = shingle_sets([text.encode(), (text + " f").encode()])
    assert a.tolist() != b.tolist()


def test_lowest_hashes(spark):
    from pyspark.sql import functions as F

    from candorlake.llm.common import lowest_hashes

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 90 == 0, "rare").otherwise("mid").alias("k"))
    places = {}
    for r in rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).collect():
        places.setdefault(r.k, []).append((r.h, r.doc_id))
    got = {(r.doc_id, r.k) for r in lowest_hashes(rows, "k", 50).collect()}
    assert got == {(i, k) for k, v in places.items() for _, i in sorted(v)[:50]}


def test_samples_take_repeated_rows_once(spark):
    """One row that fills a third of the table doesn't reach the driver more than once."""
    from pyspark.sql import functions as F

    from candorlake.llm import compression, langid

    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a text that is repeated").alias("text"), F.lit("en").alias("lang"))
    more = spark.range(10, 20).select(F.col("id").alias("doc_id"), F.concat(F.lit("another text "), "id").alias("text"), F.lit("de").alias("lang"))
    docs = hot.unionByName(more)
    windows, languages = langid.training_windows(docs, F.lit(True))
    assert sorted(set(zip(languages, windows))) == sorted(zip(languages, windows)) and len(windows) == 11
    known = docs.select("doc_id", (F.col("lang") == "en").cast("int").alias("label")).distinct()
    assert sorted(r[0] for r in compression.sample(docs, known)) == [1, *range(10, 20)]
