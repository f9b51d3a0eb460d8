import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, rank long, size string, score string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "the", "or", "in", "st", "er", "que"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small documents with null, empty, long, tied and repeated rows, and extra columns whose names clash."""
    rows = [(k, prose(k, 5 + 7 * k % 60), "en" if k % 2 else "fr", f"s{k % 3}", None, 1, "x", "y") for k in range(40)]
    rows += [(100 + k, rows[3][1], "en", "s0", 5, 1, None, "y") for k in range(12)]  # exact copies
    rows += [(150, rows[7][1] + " tail", "en", "s1", 5, 1, "x", "y"), (151, "", None, None, 0, 1, "x", "y"), (152, None, "en", None, None, 1, "x", "y")]
    rows += [(153, prose(999, 30_000), "en", "s2", 5, 1, "x", "y"), (154, " \n\t ", "en", "s2", 5, 1, "x", "y"), (155, "one", "en", "s2", 3, 1, "x", "y")]
    rows += [rows[0], (None, "no id here at all", "en", "s0", 5, 1, "x", "y")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SHAPE).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SHAPE)
