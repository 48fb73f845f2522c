import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size string, key string, gone string, _key string, _gone string, _copy string, _doc string, `a.b` string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + (".\n" if i % 9 == 8 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns whose names may clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None, "r", "s", "k", "g", "_k", "_g", "_c", "_d", "a.b") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = prose(99, 30_000)
    return [(1, None), (2, ""), (3, prose(3, 60)), (4, prose(3, 60)), (4, prose(3, 60)), (None, prose(5, 40)), (None, None), (7, "one"), (8, long), (9, long + " end"), (10, " \n\t "), (11, prose(11, 60), None, None)]
