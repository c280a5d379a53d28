"""Encoder, packing and wavelet shards against the tokenizers library itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import packing, tokens, wavelet

ODD = ["", None, "a  b", "a   b", " a", "a ", "a \n b", "a\n\n b", "x\n", "don't  stop", "it's.\nHe's", "<|endoftext|> x y", "a  b", " x y  z", "日本語 テスト", "éa b", "tab\t x", "²³ ½ x", " \n \n", "A.\nB.\nC", "foo,bar foo.baz", "'s 't 'll", "x's\ny", "🙂 🙂🙂 a🙂"]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def split(encoded):
    ids, starts = encoded
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def test_odd_texts_and_repeats():
    e = tokens.Encoder(tokens.default_tokenizer())
    assert split(e.encode(ODD)) == library(ODD)
    assert split(e.encode(ODD[::-1])) == library(ODD[::-1])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 20)
    e, rng = tokens.Encoder(tokens.default_tokenizer()), random.Random(2)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcde.,\n", k=rng.randint(1, 6))) for _ in range(30)) for _ in range(5)]
        assert split(e.encode(texts)) == library(texts)


def test_words_of_any_kind_share_a_call():
    """Words with digits, at starts of lines and with marks go to the library many in a text, and once."""

    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode(self, text, **options):
            self.texts += 1
            return self.inner.encode(text, **options)

        def encode_batch(self, texts, **options):
            self.texts += len(texts)
            return self.inner.encode_batch(texts, **options)

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    e = tokens.Encoder(tokens.default_tokenizer())
    e.tokenizer = Counted(e.tokenizer)
    rng = random.Random(5)
    words = [f"{a}{rng.choice(['', '7', '-x', "'s", 'é', '日'])}{rng.choice(['', '.', ',', '!?'])}" for a in (f"w{i:x}" for i in range(2000))]
    texts = ["".join(w + rng.choice(" \n") for w in words[at : at + 100]) + "end" for at in range(0, 2000, 100)]
    assert split(e.encode(texts)) == library(texts)
    assert e.tokenizer.texts <= 150
    before = e.tokenizer.texts
    assert split(e.encode(texts)) == library(texts) and e.tokenizer.texts == before


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab '.,\n\t\r  é1²  \x0b\x1cß日🙂s|<>", max_size=30), max_size=4))
def test_any_text(texts):
    assert split(tokens.encoder(tokens.default_tokenizer()).encode(texts)) == library(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=120))
def test_packing_of_lengths(lengths):
    bins, offsets = packing.best_fit_decreasing(np.array(lengths))
    spans = defaultdict(list)
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths, strict=True):
        spans[b].append((o, o + n))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 2048
        assert all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    assert -(-sum(lengths) // 2048) <= packing.lower_bound(np.array(lengths)) <= len(spans)


def test_bound_beats_the_mean():
    assert packing.lower_bound(np.array([1025] * 7)) == 7
    assert packing.lower_bound(np.array([700] * 9)) == 5


def expected_pieces(rows):
    out = []
    for (doc_id, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        ids = [*ids, 0]
        head = (len(ids) - 1) % 2048 + 1
        for k, (a, b) in enumerate(zip([0, *range(head, len(ids), 2048)], [*range(head, len(ids) + 1, 2048)], strict=True)):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4"))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_partition", [7, 4096])
def test_pack_documents(hard_docs, per_partition):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.select("doc_id", "text").collect()]
    got = packing.pack_documents(hard_docs, per_partition=per_partition).collect()
    assert sorted([tuple(r[:5]) for r in got], key=repr) == expected_pieces(rows)
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 2048
        assert all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    total = sum(r["length"] for r in got)
    assert len(spans) <= total / 2048 * 1.2 + 2 or per_partition == 7


def test_packed_ids(hard_docs):
    got = packing.pack_documents(hard_docs.filter("doc_id < 20"), with_ids=True).collect()
    assert got and all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)


def test_wavelet_operations():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 50_000, n) % rng.integers(1, 50_000)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16, [1], [n]).to_bytes())
        assert m.tokens().tolist() == ids.tolist()
        counts = Counter(ids.tolist())
        for t in [*list(counts)[:20], 49_999, 70_000]:
            places = np.flatnonzero(ids == t)
            assert m.count(t) == len(places)
            assert m.count(t, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
            assert [m.occurrence(t, k) for k in range(min(5, len(places)))] == places[:5].tolist()
        assert [m.access(i) for i in range(min(n, 50))] == ids[:50].tolist()


def test_shards(spark, hard_docs):
    path = wavelet.shards_in_work_folder(hard_docs, shard_tokens=3000)
    got = sorted(map(tuple, wavelet.read_documents(spark, path).collect()), key=lambda r: r[1])
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.select("doc_id", "text").collect()]
    ids = [[*i, 0] for i in library([t for _, t in rows])]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(i), zlib.crc32(np.array(i, "<u4"))) for (d, _), i in zip(rows, ids, strict=True))
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    everything = Counter(t for i in ids for t in i)
    token = everything.most_common(3)[-1][0]
    found = {r["token"]: r["n"] for r in wavelet.token_counts(spark, path, [0, token, 49_000]).collect()}
    assert found == {0: everything[0], token: everything[token], 49_000: everything[49_000]}


def test_empty_tables(spark, no_docs):
    assert packing.pack_documents(no_docs).count() == 0
    assert wavelet.read_documents(spark, wavelet.shards_in_work_folder(no_docs)).count() == 0


def test_ids_over_the_width_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    with pytest.raises(Exception, match="needs more than 4 bits"):
        wavelet.write_shards(docs, str(tmp_path / "narrow"), bits=4)


def test_small_caches_and_slices_change_nothing(hard_docs):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    plain, tight = (sorted(map(repr, packing.tokenized_pieces(hard_docs, **o).select(*columns).collect())) for o in ({}, {"kept": 3, "slice_bytes": 50}))
    assert plain == tight and packing.tokenized_pieces(hard_docs.limit(0)).count() == 0
