"""The divergence audit against plain counting, and the pointer sort against `sorted`."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sightline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, min_docs, top=50):
    uses, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        uses[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = [s for x, s in uses if x == lang]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(uses[lang, s]) for s in groups}
        q = shares(sum((uses[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def rows_of(df):
    return [(r["lang"], r["source"], r["text"]) for r in df.select("lang", "source", "text").collect()]


@pytest.mark.parametrize("min_docs", [1, 3, 10_000])
def test_equals_plain_counting(hard_docs, min_docs):
    assert got(divergence.audit(hard_docs, min_docs=min_docs)) == brute(rows_of(hard_docs), min_docs)


def test_many_blocks_buckets_and_pieces(hard_docs):
    """Small shards cut the long text in pieces; blocks of two sources and buckets of four terms split the distances."""
    assert got(divergence.audit(hard_docs, min_docs=2, shard=1000, sources=2, terms=4)) == brute(rows_of(hard_docs), 2)


def test_odd_texts(spark):
    texts = ["É x\x00y A_b ABC-abc ÄÄ", "[x]`x`{x}|~\x7fx", "", None, "\U0001f600é", "aaaaaaaa aaaaaaaab aaaaaaaaaaaaaaaa aaaaaaaa", "no", "end", "Endno"]
    rows = [(lang, s, t) for t in texts for lang, s in (("en", "a"), ("en", None), (None, "b"), ("", "b"))]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(divergence.audit(df, min_docs=1)) == brute(rows, 1)


def test_empty_table(no_docs):
    df = divergence.audit(no_docs)
    assert df.collect() == [] and df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_pointer_order():
    rng = random.Random(1)
    for leaf in (9, 64, 1 << 15):
        terms = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(3000)]
        terms += ["x" * rng.choice([8, 16, 24, 25]) for _ in range(500)]
        data = np.frombuffer("\0".join(terms).encode() + b"\0" * 9, np.uint8)
        sizes = np.array([len(t.encode()) for t in terms])
        start = np.cumsum(sizes + 1) - sizes - 1
        order, first = divergence.sorted_pointers(data, start, sizes, leaf)
        ordered = [terms[i].encode() for i in order.tolist()]
        assert ordered == sorted(t.encode() for t in terms)
        assert first.tolist() == [i == 0 or a != ordered[i - 1] for i, a in enumerate(ordered)]
