import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, near copies and columns whose names clash with the operators' own."""
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randint(3, 60))) + ".", "en", f"s{i % 3}") for i in range(60)]
    base = words(rng, 50)
    for i in range(60, 75):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(50)] = rng.choice(words(rng, 3))
        rows.append((i, " ".join(own), "de", "s0"))
    rows += [(80, None, "en", None), (81, "", None, "s1"), (82, " \n ", "en", "s1"), (83, "one", None, None), (83, "one", None, None), (84, "ONE", "en", "s2"), (None, "no id here", "en", "s0"), (None, None, None, None)]
    rows += [(90, " ".join(words(rng, 20_000)), "en", "s2"), (91, rows[0][1], "fr", "s1"), (92, rows[0][1], "fr", "s1"), (-5, rows[0][1], "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("size", "_salt", "label", "id", "a", "b", "position", "_part", "pass", "length", "count"):
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
