"""The pipeline's stages, each on its own input, and the registered queries of the subpackage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline

from sightline.llm import mixing
from sightline.llm.queries import ORACLES, QUERIES

from test_dedup import near_brute


def test_stages_on_hard_rows(spark, hard_docs, no_docs):
    docs = hard_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        before, after = (Counter((r["doc_id"], r["text"]) for r in d.collect()) for d in (docs, out))
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert set(after) == {(r[0], t) for r, t in ((r, t) for r in near_brute(rows, width=5) for i, t in rows if i == r[0]) if r[3]}
        elif name == "mixing":
            passes = Counter(r["doc_id"] for r in mixing.mix(docs).filter("position IS NOT NULL").collect())
            assert Counter(r["doc_id"] for r in out.collect()) == passes
        else:
            assert not after - before
        assert stage(spark, no_docs, "").count() == 0
        docs = out
    packed = corpus_pipeline.packed(spark, docs, "")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.packed(spark, no_docs, "").count() == 0


def test_language_stage_rejects_only_what_has_no_language(spark):
    rows = [(i, "the house and the tree are here", "en") for i in range(40)] + [(i, "das haus und der baum sind hier", "de") for i in range(40, 80)] + [(90, "12 34 !!", "en"), (91, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert left == set(range(80))


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
