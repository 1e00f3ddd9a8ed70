"""Packing: every id once, sequences whole, little padding; matrices round trip."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from candorlake.llm import bfd, packing
from candorlake.llm.tokens import ChunkTokenizer, default_tokenizer, token_counts


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 2]


def test_tokens_equal_the_library(plain, monkeypatch):
    r = random.Random(1)
    letters = list("abAB.,' \n'sSt019é́İΣ<|>endoftext​　-ÄÖÜßñçÿŸøØ×÷")
    own = ChunkTokenizer(default_tokenizer())
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(4000)] + ["a<|endoftext|>b <|ENDOFTEXT|> it's", "x" * 3000 + ". " + "ab" * 2000, "", " a. ", "é. é.. ñ,, b!? c!' d.'s 3. x. "]
    monkeypatch.setattr("candorlake.llm.tokens.PART_BYTES", 3000)
    got = own.encode_all(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_memo_may_run_over(plain, monkeypatch):
    monkeypatch.setattr("candorlake.llm.tokens.MEMO_ENTRIES", 50)
    own = ChunkTokenizer(default_tokenizer())
    for i in range(30):
        texts = [" ".join(f"word{j}" for j in range(i * k % 90, i * k % 90 + 20)) for k in range(1, 6)]
        assert [np.frombuffer(g, "<u4").tolist() for g in own.encode_all(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(rows, texts, plain, slack=0.02):
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
    padded = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
        padded += 0 if end & (end - 1) == 0 else packing.CAPACITY - end
    want = Counter((d, tuple(ids_of(plain, t))) for d, t in texts)
    got = Counter()
    for d, pieces in by_doc.items():
        copies = sum(k[0] == d for k in want.elements())
        pieces.sort(key=lambda p: p[0])
        if copies == 1:
            assert [p[0] for p in pieces] == list(np.cumsum([0, *[len(p[1]) for p in pieces]])[:-1])
            got[d, tuple(i for p in pieces for i in p[1])] += 1
            assert {p[2] for p in pieces} == {sum(len(p[1]) for p in pieces)}
        else:
            assert sum(len(p[1]) for p in pieces) == sum(len(k[1]) for k in want.elements() if k[0] == d)
            got.update({k: v for k, v in want.items() if k[0] == d})
    assert got == want
    return padded / max(1, sum(length for p in sequences.values() for _, length in p))


def test_pack_documents(docs, plain):
    rows = packing.pack(docs).collect()
    assert check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], plain) < 0.02


def test_pack_odd(odd, empty, plain):
    check_packed(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()], plain)
    assert packing.pack(empty).collect() == []


def test_classes_hold_their_number():
    r = random.Random(3)
    docs = [(i, bytes(4 * r.choice([1, 5, 900, 1366, 2048, 2049, 4095, 4096, 4097, 9000]))) for i in range(3000)]
    for k, pieces in packing.harmonic_bins(docs):
        assert k == 0 or len(pieces) == k and all(p.length <= packing.CAPACITY // k for p in pieces)
        assert sum(p.length for p in pieces) <= packing.CAPACITY


def test_room_tree_finds_the_best_fit():
    r = random.Random(2)
    tree, rooms = bfd.RoomTree(100), []
    for i in range(3000):
        need = r.randint(1, 100)
        fit = min((x for x in rooms if x >= need), default=None)
        found = tree.take(need)
        assert (found and found[0]) == fit
        if found:
            rooms.remove(fit)
        room = r.randint(0, 100)
        tree.add(room, i)
        rooms.append(room)


@pytest.mark.parametrize("window", [2000, 4_000_000])
def test_best_fit_keeps_all(window):
    r = random.Random(4)
    docs = [(i, np.arange(n := r.choice([1, 3, 700, 1500, 2048, 2049, 7000]), dtype="<u4").tobytes()) for i in range(600)]
    got = defaultdict(list)
    for row in bfd.best_fit_rows(docs, 2048, window):
        assert 0 < sum(p.length for p in row) <= 2048
        for p in row:
            got[p.doc_id].append((p.start, p.ids))
    assert {d: b"".join(x for _, x in sorted(v)) for d, v in got.items()} == dict(docs)


def test_matrices_round_trip(odd, empty, docs, plain):
    for table in (docs, odd):
        found = Counter()
        pieces = defaultdict(list)
        for r in bfd.pack_matrices(table).collect():
            ids, at = np.frombuffer(bytes(r.input_ids), "<u4"), np.frombuffer(bytes(r.position_ids), "<u2")
            assert len(ids) == len(at) == bfd.CAPACITY and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
            for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
                assert at[a:b].tolist() == list(range(b - a))
                pieces[d].append((s, ids[a:b].tolist()))
        want = Counter((r.doc_id, tuple(ids_of(plain, r.text))) for r in table.collect())
        for d, parts in pieces.items():
            copies = [k for k in want.elements() if k[0] == d]
            if len(copies) == 1:
                found[d, tuple(i for _, p in sorted(parts) for i in p)] += 1
            else:
                assert Counter(i for _, p in parts for i in p) == Counter(i for k in copies for i in k[1])
                found.update(copies)
        assert found == want
    assert bfd.pack_matrices(empty).collect() == []


def test_write_matrices(spark, docs, tmp_path):
    bfd.write_matrices(bfd.pack_matrices(docs), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() > 300


def test_counts(odd, empty, plain):
    want = Counter((r.doc_id, len((r.text or "").encode().split()), len(ids_of(plain, r.text)) - 1, r.source) for r in odd.collect())
    assert Counter((r.doc_id, r.n_words, r.n_tokens, r.source) for r in token_counts(odd, ("source",)).collect()) == want
    assert token_counts(empty).collect() == []
