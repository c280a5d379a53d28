"""SimHash classes against all pairs, and fingerprints against counting bit by bit."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import simhash


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(prints, most=3):
    """Smallest place that each fingerprint reaches."""
    root = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= most:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = classes(prints)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root[k] == root[i] and d is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_equals_all_pairs(hard_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.select("doc_id", "text").collect()]
    assert got(simhash.near_duplicates(hard_docs)) == brute(rows)


def test_empty_table(no_docs):
    df = simhash.near_duplicates(no_docs)
    assert df.collect() == [] and df.columns == ["doc_id", "fingerprint", "component_id"]


def test_spark_hash_is_the_same(spark):
    """Spark's own xxhash64 has seed 42, too."""
    texts = ["one two three", "é ü ß", "a" * 100, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h"))
    assert [r["h"] % 2**64 for r in df.collect()] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("piece", [1, 7, 50, 1 << 20])
def test_pieces_of_long_texts(piece):
    rng = random.Random(piece)
    for n in (0, 1, 2, 3, 4, 700):
        text = " \n".join(rng.choice(["Ab", "éE", "x\x85y", "q"]) for _ in range(n))
        hashes = [h for part in simhash.shingle_hashes(text, 3, piece) for h in part]
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
        want = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        assert hashes == want


def spread(rng, base, n, flips):
    out = []
    for _ in range(n):
        x = base
        for k in rng.sample(range(64), flips()):
            x ^= 1 << k
        out.append(x)
    return out


@pytest.mark.parametrize("block", [4, 32, 1024])
def test_links_in_crowded_cells(spark, block):
    """Clusters of fingerprints and chains; small blocks send cells through the quarters and through pairs of blocks."""
    rng = random.Random(block)
    prints = {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    for _ in range(4):
        prints |= set(spread(rng, rng.getrandbits(64), 60, lambda: rng.randint(0, 5)))
    prints |= set(spread(rng, 0, 60, lambda: rng.randint(1, 3)))
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, block).collect()]
    place = {x: i for i, x in enumerate(signed)}
    root = list(range(len(prints)))
    for a, b in edges:
        x, y = root[place[a]], root[place[b]]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == classes(prints)
    if block == 1024:  # every cell connects its rows, so edges stay under the rows of cells
        assert len(edges) < 50 * len(prints)
