"""Rollups: any order of signed batches, repeats and compaction give the brute-force totals."""

import random
from collections import Counter

from candorlake.llm import queries, rollup

COUNTS = "source string, lang string, tokenizer string, n_tokens long"


def test_batches(spark, tmp_path):
    r = random.Random(7)
    store = rollup.TokenRollup(spark, str(tmp_path))
    assert store.totals().collect() == []
    want, live = Counter(), []
    for number in range(5):
        new = [(r.choice(["a", None]), r.choice(["en", "de"]), "v1", r.choice([0, 3, 50, None])) for _ in range(40)]
        gone = [live.pop(r.randrange(len(live))) for _ in range(min(len(live), 10))]
        moved = [(*x[:3], (x[3] or 0), (x[3] or 0) + 5) for x in live[:5]]
        live[:5] = [(*m[:3], m[4]) for m in moved]
        live += new
        changes = [rollup.inserts(spark.createDataFrame(new, COUNTS)), rollup.deletes(spark.createDataFrame(gone, COUNTS)), rollup.revisions(spark.createDataFrame(moved, "source string, lang string, tokenizer string, old_tokens long, n_tokens long"))]
        assert store.commit(f"b{number}", *changes)
        if number % 2:
            assert not store.commit(f"b{number}", *changes)
        if number == 3:
            store.compact()
            assert not store.commit("b1", changes[0])
    for s, lang, v, n in live:
        want[s, lang, v, "docs"] += 1
        want[s, lang, v, "tokens"] += n or 0
    got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in store.totals().collect()}
    assert got == {k[:3]: (want[(*k[:3], "docs")], want[(*k[:3], "tokens")]) for k in want}


def one(spark, n):
    return rollup.inserts(spark.createDataFrame([("s", "en", "v", n)], COUNTS))


def rows(store):
    return [tuple(r) for r in store.totals().collect()]


def test_half_written_batch_does_not_count(spark, tmp_path):
    store = rollup.TokenRollup(spark, str(tmp_path))
    store.commit("a", one(spark, 3))
    (tmp_path / "attempt-1").mkdir()
    store._summed(one(spark, 4)).write.parquet(str(tmp_path / "attempt-2"))
    assert rows(store) == [("s", "en", "v", 1, 3)]


def test_first_commit_of_an_id_stands(spark, tmp_path, monkeypatch):
    store = rollup.TokenRollup(spark, str(tmp_path))
    other = rollup.TokenRollup(spark, str(tmp_path))
    summed = other._summed
    monkeypatch.setattr(other, "_summed", lambda df: (store.commit("a", one(spark, 3)), summed(df))[1])
    assert not other.commit("a", one(spark, 5))  # a second driver, faster, was there first
    monkeypatch.undo()
    assert rows(store) == [("s", "en", "v", 1, 3)] and not store.commit("a", one(spark, 9))


def test_commit_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    store = rollup.TokenRollup(spark, str(tmp_path))
    store.commit("a", one(spark, 3))
    sums = store._sums
    monkeypatch.setattr(store, "_sums", lambda *x: (store.commit("b", one(spark, 4)), sums(*x))[1])
    store.compact()
    monkeypatch.undo()
    assert rows(store) == [("s", "en", "v", 2, 7)]
    store.compact()
    assert rows(store) == [("s", "en", "v", 2, 7)] and not store.commit("b", one(spark, 4))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["snapshot-000000001"]


def test_crash_before_old_batches_are_deleted(spark, tmp_path, monkeypatch):
    store = rollup.TokenRollup(spark, str(tmp_path))
    store.commit("a", one(spark, 3))
    (tmp_path / "batch-a").rename(tmp_path / "aside")
    (tmp_path / "aside").rename(tmp_path / "batch-a")
    import shutil

    shutil.copytree(tmp_path / "batch-a", tmp_path / "copy")
    store.compact()
    (tmp_path / "copy").rename(tmp_path / "batch-a")
    assert rows(store) == [("s", "en", "v", 1, 3)]


def test_repeats_nulls_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([("s", "en", "v", 3)] * 2 + [(None, None, None, None)], COUNTS).withColumns({c: F.lit(c) for c in ("n_docs", "sums", "value", "ids")})
    store = rollup.TokenRollup(spark, str(tmp_path))
    store.commit("a", rollup.inserts(made))
    assert sorted(rows(store), key=str) == sorted([("s", "en", "v", 2, 6), (None, None, None, 1, 0)], key=str)


def test_query(spark, docs):
    from tokenizers import Tokenizer

    from candorlake.llm.tokens import default_tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for r in docs.collect():
        n = len((r.text or "").encode().split())
        for k, v in (("docs", 1), ("tokens", len(plain.encode(r.text or "", add_special_tokens=False).ids))):
            want[r.source, r.lang, "word_bpe_49k", k] += v
        if n % 5 == 0:
            for k, v in (("docs", 1), ("tokens", n)):
                want[r.source, r.lang, "words", k] += v
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in queries.op8_token_rollup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k[:3]: (want[(*k[:3], "docs")], want[(*k[:3], "tokens")]) for k in want}
