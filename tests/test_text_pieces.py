"""Pieces of texts and low-signal texts against plain Python, rule by rule."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sightline.functions import text

SPACE = "".join(text.WS_CHARS)
JAVA_SPACE = "[ \t\n\x0b\f\r]"


def strip(s):
    return s.strip(SPACE)


def edge(s):
    return s.strip(" ,;")


def pieces(body):
    out = []
    for sentence in re.split(rf"[;\n]+|(?<=[.!?]){JAVA_SPACE}+", body):
        sentence = edge(re.sub(f"[{re.escape(SPACE)}]+", " ", strip(sentence)).strip(" "))
        for piece in re.split(rf",{JAVA_SPACE}+(?=[A-Za-z0-9])", sentence):
            if edge(piece):
                parts = [edge(p) for p in re.split(rf"{JAVA_SPACE}+(?:and|but){JAVA_SPACE}+", edge(piece)) if edge(p)]
                out += parts if len(parts) > 1 else [edge(piece)]
    return out


def low(body):
    seen = "".join(ch for ch in body or "" if ch not in SPACE)
    letters = "".join(ch for ch in seen if ch.isalpha() or ch.isnumeric()).lower()
    one = lambda s: len(s) >= 8 and len(set(s)) == 1
    return not letters or one(seen) or one(letters)


def made(rng, words, n):
    return "".join(rng.choice(words) for _ in range(rng.randint(0, n)))


def test_pieces(spark):
    rng = random.Random(12)
    words = ["a", "Bee", "and", "but", " and ", " but ", " ", "  ", ", ", ",", ";", "\n", ". ", ".", "! ", "? ", "\t", "\xa0", " ", "é", "9", "x and", "and y", " ,and ", "\x1c"]
    texts = [made(rng, words, 14) for _ in range(3000)] + ["and a and but b but and", " ; and x, and y. But z ,; ", "", None, ", ,", "a and , b", "one, two and three; four but five.\nsix"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["p"] for r in rows.select("i", text.atomic_pieces(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else pieces(t)), t


def test_low_signal(spark):
    rng = random.Random(13)
    words = ["a", "A", "aa", "AAAA", "-", "--", "é", "É", " ", "\n", "\xa0", "!!!!", "8", "88888888", "²"]
    texts = [made(rng, rng.sample(words, rng.randint(1, 3)), 12) for _ in range(3000)] + ["", None, "!!!!!!!!", "a" * 8, "a" * 7, "aAaAaAaA", "a-a-a-a-a-a-a-a", "xxxxxxxxy", "\n".join("z" * 8)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["low"] for r in rows.select("i", text.is_low_signal(F.col("t")).alias("low")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == low(t), t
