"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sightline.llm import exact_dedup, lsh_forest
from sightline.llm.components import connected_components


def exact_brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_exact_groups(hard_docs):
    got = exact_dedup.exact_groups(hard_docs, digest_all=True).collect()
    assert sorted(map(tuple, got), key=repr) == exact_brute(pairs(hard_docs))


def test_unique_texts_are_not_hashed_whole(hard_docs):
    got = exact_dedup.exact_groups(hard_docs).collect()
    assert {r["group_size"] == 1 and r["text_sha256"] is None for r in got} == {True, False}
    assert all(r["text_sha256"] for r in got if r["group_size"] > 1)


def test_same_prefix_and_length_is_no_copy(spark):
    docs = spark.createDataFrame([(1, "a" * 300 + "x"), (2, "a" * 300 + "y"), (3, "a" * 300 + "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True)}


def test_drop_exact_copies_keeps_columns_and_one_of_each(hard_docs):
    left = exact_dedup.drop_exact_copies(hard_docs)
    assert left.columns == hard_docs.columns
    texts = [t or "" for _, t in pairs(left)]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in pairs(hard_docs)})


def near_brute(rows, percent=80, width=2):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for n, (doc_id, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        own = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        sets[n] = (doc_id, own)
    parent = {i: i for i, _ in sets.values() if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [s for s in sets.values() if s[0] is not None and s[1]]
    for k, (a, x) in enumerate(items):
        for b, y in items[k + 1 :]:
            if 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted([(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets.values()], key=repr)


def test_near_duplicates(hard_docs):
    for width in (2, 5):
        got = sorted(map(tuple, lsh_forest.near_duplicates(hard_docs, width=width).collect()), key=repr)
        assert got == near_brute(pairs(hard_docs), width=width)


def test_many_blocks_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join(base[:-1] + [f"end{i // 3}"] if i < 40 else base[i - 40 :] + [f"x{k}" for k in range(i - 40)])) for i in range(70)]
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    got = sorted(map(tuple, lsh_forest.near_duplicates(docs).collect()), key=repr)
    assert got == near_brute(chain)


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    """Texts of one boilerplate share short prefixes by the hundred; true copies among them stand far apart in every order."""
    # One region of one order stands for regions of thousands of sets in all of them.
    signatures = lsh_forest.signatures
    monkeypatch.setattr(lsh_forest, "signatures", lambda *a: signatures(*a).withColumn("prefixes", F.array(F.lit(1).cast("long"))))
    rng = random.Random(8)
    plate = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(plate + [f"o{i}x{k}" for k in range(40)])))
    for i in range(0, 150, 5):
        own = rows[i][1].split()
        for k in range(5):
            own[60 + 8 * k] = f"n{i}x{k}"  # similarity near 0.8
        rows.append((200 + i, " ".join(own)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lsh_forest.near_duplicates(docs, neighbours=2, salts=2).collect()), key=repr)
    want = near_brute(rows)
    assert sum(not r[3] for r in want) == 30 and got == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 900), (3, 3)], "a long, b long")
    got = {r["id"]: r["label"] for r in connected_components(edges).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert (got[5], got[7], got[900]) == (5, 5, 5) and 3 not in got


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_empty_tables(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_exact_copies(no_docs).count() == 0
    assert lsh_forest.near_duplicates(no_docs).count() == 0
