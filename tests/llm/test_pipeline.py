"""The pipeline's stages, each on its own input."""

import corpus_pipeline as pipeline
from candorlake.llm import neardup, secretscan

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, docs, tmp_path):
    now = docs
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in now.collect()}
        stage(spark, now, FOLDER).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in now.collect()}
        assert now.columns == COLUMNS and set(after) <= set(before) and len(after) == now.count()
        gone = set(before) - set(after)
        if name == "near_duplicates":
            kept = {r.doc_id for r in neardup.near_duplicates(spark.createDataFrame(list(before.values()), docs.schema), 80).filter("kept").collect()}
            assert set(after) == kept
        if name == "decontamination":
            items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            exact = {d for d, r in before.items() for i in items.collect() if i.text in r.text}
            assert exact <= gone and len(gone - exact) <= 2
        if name == "secrets":
            changed = [d for d in after if after[d].text != before[d].text]
            assert not gone and changed and all(secretscan.base_spans(before[d].text) and after[d].n_chars == len(after[d].text) for d in changed)
            assert not any(secretscan.base_spans(r.text) for r in after.values())
        else:
            assert all(after[d] == before[d] for d in after)
        sizes.append(len(after))
    assert sizes[0] >= 0.99 * docs.count() and sizes == sorted(sizes, reverse=True)
    pieces = pipeline.STAGES[-1][1](spark, now, FOLDER).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}


def test_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").filter("length <= 0 OR length > 4096").isEmpty()


def row(doc_id, text):
    return (doc_id, text, "en", "s", None if text is None else len(text))


def test_rows_go_by_their_text(spark, docs):
    """Clashing ids with unlike texts, and rows without an id."""
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("length(text) > 60").limit(1).collect()
    a = "we walked along the river to the old mill and talked about the weather for a long while before we went home again"
    b = "the committee published a short report on the state of the roads in the northern district of the country last week"
    leak = f"{b} {items[0].text} {a}"
    rows = [row(1, a), row(1, b), row(1, a), row(None, leak), row(7, leak), row(None, a + " then"), row(None, None), row(2, "½ ² Ⅷ ①"), row(None, "")]
    made = spark.createDataFrame(rows, docs.schema).repartition(3)
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert got(pipeline.decontamination(spark, made, FOLDER)) == sorted(((r[0], r[1]) for r in rows if r[1] != leak), key=str)
    assert got(pipeline.near_duplicates(spark, made, FOLDER)) == sorted([(1, a), (1, b), (7, leak), (None, None), (None, ""), (2, "½ ² Ⅷ ①")], key=str)
    learned = pipeline.language(spark, docs.unionByName(made), FOLDER)
    assert got(learned.filter("source = 's'")) == sorted(((r[0], r[1]) for r in rows if r[1] and len(r[1]) > 20), key=str)


def test_many_keys_are_joined_by_a_shuffle(spark, docs, monkeypatch):
    some = docs.limit(150)
    want = sorted(r.doc_id for r in pipeline.near_duplicates(spark, some, FOLDER).collect())
    monkeypatch.setattr("candorlake.llm.common.BROADCAST_KEYS", 0)
    monkeypatch.setattr(neardup, "BROADCAST_NODES", 0)
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, some, FOLDER).collect()) == want and len(want) < 150


def test_odd(spark, odd, empty):
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, odd, FOLDER)
        before, after = [sorted(map(str, df.collect())) for df in (odd, got)]
        assert got.columns == odd.columns and (name == "secrets" or set(after) <= set(before))
        assert len(after) == {"near_duplicates": 10, "decontamination": 12, "secrets": 12}.get(name, len(after))
        assert stage(spark, empty, FOLDER).collect() == []
    kept = pipeline.near_duplicates(spark, odd, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i in (None, 1, 2, 3, 4, 5, 7, 8, 9, 10))
    assert {r.doc_id for r in pipeline.language(spark, odd, FOLDER).collect()}.isdisjoint({1, 2, 3, 10})
    pieces = pipeline.pack(spark, odd, FOLDER).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in odd.collect()}
    assert pipeline.pack(spark, empty, FOLDER).collect() == []
