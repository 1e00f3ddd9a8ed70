"""Decontamination: the search equals brute force; planted items are found, clean text is left alone."""

import random
from collections import Counter, defaultdict

from candorlake.llm import decontam


def index_of(items):
    units = [u for _, t in items for u in decontam.units_of(t)]
    frequency = Counter(t for u in units for t in set(u))
    return decontam.Index(items, frequency, len(units), sum(map(len, units)) / len(units))


def made(r, n):
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "a"] * 60
    return " ".join(r.choice(vocabulary) for _ in range(n))


def test_search_equals_brute_force():
    r = random.Random(5)
    items = [(i, made(r, r.choice([3, 20, 60, 150]))) for i in range(70)]
    index = index_of(items)
    texts = [made(r, r.choice([0, 1, 64, 300])) + " " + r.choice(["", items[r.randrange(70)][1]]) + " " + made(r, 30) for _ in range(80)]
    lists = [decontam.words_of(t) for t in texts]
    terms = {v: k for k, v in index.vocabulary.items()}
    weights = defaultdict(dict)
    for c in range(len(index.cells)):
        for p in range(index.cell_start[c], index.cell_start[c + 1]):
            weights[int(index.unit[p])][terms[int(index.cells[c]) // index.n_blocks]] = float(index.weight[p])
    want = {}
    for d, words in enumerate(lists):
        for s in range(0, len(words), decontam.STEP):
            q = set(words[s : s + 2 * decontam.STEP])
            for unit, w in weights.items():
                score = sum(v for t, v in w.items() if t in q)
                if score >= decontam.THRESHOLD - 1e-9:
                    want[d, s, unit] = round(score, 9)
    assert {(d, s, u): round(x, 9) for d, s, u, x in index.search(lists)} == want and len(want) > 40


def test_weights_are_bm25():
    """The index's weights against the formula, from plain counts of the texts."""
    import math
    import re

    r = random.Random(9)
    items = [(i, made(r, r.choice([5, 64, 70, 200]))) for i in range(25)]
    index = index_of(items)
    units = [w[i : i + 64] for _, t in sorted(items, key=lambda x: (str(x[0]), x[1])) for w in [re.findall(r"\w+", t.lower())] for i in range(0, len(w), 64)]
    mean = sum(map(len, units)) / len(units)
    df = Counter(t for u in units for t in set(u))
    want = {}
    for k, u in enumerate(units):
        of = {t: math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(u) / mean)) for t, n in Counter(u).items()}
        want |= {(k, t): w / sum(of.values()) for t, w in of.items()}
    terms = {v: k for k, v in index.vocabulary.items()}
    got = {(int(index.unit[p]), terms[int(index.cells[c]) // index.n_blocks]): float(index.weight[p]) for c in range(len(index.cells)) for p in range(index.cell_start[c], index.cell_start[c + 1])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_clean_keeps_rows_as_they_are(spark, odd, empty):
    items = spark.createDataFrame([("a", "the quick brown fox jumps over the lazy dog"), ("b", None)], "item_id string, text string")
    for chars in (decontam.ITEM_CHARS, 20):
        got = decontam.clean(odd, items, chars)
        assert got.columns == odd.columns and sorted(map(str, got.collect())) == sorted(str(r) for r in odd.collect() if r.doc_id not in (5, 6))
    assert decontam.clean(empty, items).collect() == [] and decontam.clean(odd, items.filter("false")).count() == odd.count()


def test_planted(spark):
    r = random.Random(6)
    items = [(100 + i, ". ".join(made(r, n).capitalize() for n in ([12, 9] if i % 2 else [25])) + ".") for i in range(30)] + [(900, None), (901, ""), (902, "..."), (110, made(r, 14))]
    items.append(items[0])
    rows, want = [], set()
    for d in range(120):
        text = made(r, 150)
        if d % 3 == 0:
            item = items[d // 3 % 30]
            spot = r.randrange(len(text))
            text = text[:spot] + " " + r.choice([item[1], item[1].upper(), item[1].replace(" ", "\n ")]) + " " + text[spot:]
            want.add((d, item[0]))
        rows.append((d, text))
    rows += [(None, items[3][1]), (500, None), (501, "")]
    want.add((None, items[3][0]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contamination(docs, benchmark).collect()}
    assert got == want
    parts = {(x.doc_id, x.item_id) for x in decontam.contamination(docs, benchmark, item_chars=500).collect()}
    assert parts == want


def test_documents(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(x.doc_id, x.item_id) for x in decontam.contamination(docs, items).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    assert got >= exact and len(got - exact) <= 2 and exact


def test_odd(spark, odd, empty):
    items = spark.createDataFrame([("a", "the quick brown fox jumps over the lazy dog"), ("b", None)], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contamination(odd, items).collect()} == {(5, "a"), (6, "a")}
    assert decontam.contamination(empty, items).collect() == [] and decontam.contamination(odd, items.filter("false")).collect() == []


def test_question_and_answer():
    assert decontam.question_and_answer("What is it? A b c.") == (["what", "is", "it"], ["a", "b", "c"])
    assert decontam.question_and_answer("a b c d") == (["a", "b", "c"], ["d"]) and decontam.question_and_answer("") == ([], [])
