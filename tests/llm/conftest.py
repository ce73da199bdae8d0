import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, id long, position long, n_removed string, spans string, piece long, row int"
)


def table(spark, texts, start=0):
    """Documents with further columns whose names the operators use themselves."""
    rows = [
        (None if i is None else i, t, "en", "s", 0, "k", 1, 2, "x", "y", 3, 4)
        for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts, start))
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def words():
    """Invented words, the same in every run."""
    draw = random.Random(5)
    return ["".join(draw.choices("abcdefghiklmnoprstuv", k=draw.randint(3, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd(spark, words):
    """Null, empty, blank and very long texts, repeated rows, ties, and rows without an id."""
    draw = random.Random(6)
    long = " ".join(draw.choices(words, k=60_000))
    prose = " ".join(draw.choices(words, k=120))
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, prose), (3, prose), (4, prose), (5, long)]
    rows += [(None, prose), (None, None), (6, "one"), (7, "?!"), (8, prose + " more")]
    frame = spark.createDataFrame(
        [(i, t, None if i == 3 else "en", None if i == 4 else "s", 0, "k", 1, 2, "x", "y", 3, 4) for i, t in rows],
        SCHEMA,
    )
    return frame.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
