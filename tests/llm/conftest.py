import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 3, n: int = 60):
    """Texts with copies, near copies, shared passages, repeats, odd texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghioéß") for _ in range(r.randint(1, 9))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = say(120)
    rows = []
    for i in range(n):
        t = say(r.choice([3, 20, 80, 200]))
        if i % 6 == 1:
            t = rows[-1][1]
        if i % 6 == 2 and rows[-2][1]:
            w = rows[-2][1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 7 == 3:
            t = say(9) + " " + passage[r.randint(0, 60) :] + " " + say(7)
        if i % 11 == 5:
            t = "na " * 300
        rows.append((i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n ", "en", "b", 4), (n + 3, "solo", "en", "c", 4), (n + 4, "x" * 1500, "en", "a", 1500), (n + 5, "ab" * 900 + "\x0b\x0c\r", "en", "a", 1803)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    t = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    # extra columns, some with the operators' own names
    return t.select("*", F.lit("x").alias("k"), F.lit(1).alias("raw"), F.lit(2).alias("size"), F.lit(3).alias("component_id"), F.lit(4).alias("part"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
