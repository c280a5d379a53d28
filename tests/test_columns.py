"""Literal rows for the column functions."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import ids, jsons, markers, text, timing, vectors
from sightline.operators.lookups import quoted_phrases


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("hint", "lo", "hi", "want"),
    [
        ("6s", 0.0, 10.0, 6.0),
        ("frame at 6.00 seconds", 0.0, 10.0, 6.0),
        ("00:06", 0.0, 10.0, 6.0),
        ("1:23", 0.0, 100.0, 83.0),
        ("50%", 10.0, 20.0, 15.0),
        ("3 seconds before end", 0.0, 10.0, 7.0),
        ("start", 4.0, 9.0, 4.0),
        ("nothing", 4.0, 9.0, None),
    ],
)
def test_hint_anchor(spark, hint, lo, hi, want):
    assert one(spark, timing.hint_anchor(F.lit(hint), F.lit(lo), F.lit(hi))) == want


def test_hint_clip(spark):
    clip = one(spark, timing.hint_clip(F.lit("last 20%"), F.lit(100.0)))
    assert (clip.start_s, clip.end_s) == (80.0, 100.0)
    clip = one(spark, timing.hint_clip(F.lit("middle 10 seconds"), F.lit(100.0)))
    assert (clip.start_s, clip.end_s) == (45.0, 55.0)


def test_confidence_percent_word_and_range(spark):
    rows = spark.createDataFrame([("85%",), ("Very High",), ("n/a",), ("1.2",), ("0.4",)], "c string")
    got = [r[0] for r in rows.select(text.coerce_confidence(F.col("c"))).collect()]
    assert got == [0.85, 0.95, None, None, 0.4]


def test_scores_round_half_even_and_clamp(spark):
    scores = F.create_map(*[F.lit(x) for x in ("a", "0.18", "b", "5.7", "c", "2.2", "d", "2.5", "e", "bad")])
    assert one(spark, text.band(scores)) == {"a": 1, "b": 5, "c": 2, "d": 2}


def test_number_loses_its_sign(spark):
    assert one(spark, text.numeric_from_text(F.lit("fell -5 to $1,234.50"))) == 5.0


def test_low_signal(spark):
    rows = spark.createDataFrame([("",), ("!!! ...",), ("zzzzzzzz",), ("ab",), ("aAaAaAaA",)], "t string")
    assert [r[0] for r in rows.select(text.is_low_signal(F.col("t"))).collect()] == [True, True, True, False, True]


def test_sentences_and_pieces(spark):
    assert one(spark, text.sentence_chunks(F.lit("Hello there. The score is 10."))) == ["Hello there.", "The score is 10."]
    assert one(spark, text.atomic_pieces(F.lit("A man runs, a dog barks and a car stops."))) == [
        "A man runs",
        "a dog barks",
        "a car stops.",
    ]


def test_quoted_phrases(spark):
    said = "who said \"go home\" or 'come to bill's ammunition' and 'no'"
    rows = quoted_phrases(spark.range(1).withColumn("said", F.lit(said)), ["id"], "said").orderBy("pos").collect()
    assert [r["phrase"] for r in rows] == ["go home", "come to bill's ammunition"]


def test_options_keep_letters_and_gold_counts_after_blanks(spark):
    got = one(spark, text.letter_options(F.array(F.lit("x"), F.lit(" "), F.lit("y")), F.lit(1)))
    assert got.options == ["A. x", "C. y"]
    assert got.gold == "C. y"


def test_list_field(spark):
    rows = spark.createDataFrame([('["a", " ", "b"]',), ('{"2": "b", "1": "a"}',), ("a || b",), ("one",), (" ",)], "t string")
    assert [r[0] for r in rows.select(text.parse_list_field(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], ["a", "b"], ["one"], None]


def test_anchor_text_does_not_merge(spark):
    pairs = F.array(*[F.struct(F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for a, b in [(2.377, 22.323), (22.323, 41.847)]])
    none = F.lit(None).cast("double")
    assert one(spark, timing.anchor_text(pairs, none, none, none)) == "2.377s to 22.323s; 22.323s to 41.847s"


def test_box_explained_by_a_larger_canvas(spark):
    box = F.array(*[F.lit(float(v)) for v in (207, 906, 795, 977)])
    fitted = one(spark, vectors.fit_box(box, F.lit(640), F.lit(360)))
    assert [round(v, 3) for v in fitted] == [69.0, 302.0, 265.0, 325.667]


def test_path_lookup_by_label(spark):
    doc = F.try_parse_json(F.lit('{"regions": [{"label": "puzzle region", "id": 4}, {"label": "x", "id": 5}]}'))
    assert one(spark, jsons.json_path(doc, "regions.puzzle.id")) == "4"
    assert one(spark, jsons.json_path(doc, "regions[].id")) == "[4,5]"
    assert one(spark, jsons.json_path(doc, "regions[1].id")) == "5"
    assert one(spark, jsons.json_path(doc, "regions.9.id")) is None


def test_intervals_in_answers(spark):
    raw = '[{"start":1.5,"end":3.0},{"start_s":4.0,"end_s":5.5}]'
    got = one(spark, jsons.text_intervals(F.lit(raw), F.lit(10.0)))
    assert [(i.start_s, i.end_s) for i in got] == [(11.5, 13.0), (14.0, 15.5)]
    got = one(spark, jsons.text_intervals(F.lit("from 3s to 4.5s"), F.lit(0.0)))
    assert [(i.start_s, i.end_s) for i in got] == [(3.0, 4.5)]


def test_absolute_times(spark):
    n = lambda v: F.lit(v).cast("long")
    got = one(spark, timing.absolute_ms(n(1000), n(2000), n(10_000), n(20_000)))
    assert (got.start_ms, got.end_ms) == (11_000, 12_000)
    got = one(spark, timing.absolute_ms(n(12_000), n(13_000), n(10_000), n(20_000)))
    assert (got.start_ms, got.end_ms) == (12_000, 13_000)


def test_paths_are_redacted(spark):
    got = one(spark, text.redact_paths(F.lit("see /srv/app/run/a.json and /home/me/x"), root="/srv/app"))
    assert got == "see run/a.json and <redacted-path>"


def test_observation_id_ignores_sources(spark):
    none = F.lit(None).cast("double")
    args = [F.lit(x) for x in ("asr", "speaker_1", "said", 'speaker_1 said "hello"', "hello")]
    first = one(spark, ids.observation_id(*args, F.lit(1.0), F.lit(2.0), none))
    import hashlib
    import json

    body = {"tool_name": "asr", "subject": "speaker_1", "predicate": "said", "atomic_text": 'speaker_1 said "hello"', "object_text": "hello"}
    body |= {"time_start_s": 1.0, "time_end_s": 2.0, "frame_ts_s": None}
    text_ = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert first == "obs_" + hashlib.sha256(text_.encode()).hexdigest()[:16]


def test_sample_key(spark):
    assert one(spark, ids.sample_key(F.lit("/v/my clip.mp4"), F.lit("q"), F.lit("7"))) == "my_clip__qid7"


def test_question_tags(spark):
    got = one(spark, markers.question_tags(F.lit("What is the relationship between the first and last man?")))
    assert got == ["several_order_words", "relation", "ordinal_slot"]
