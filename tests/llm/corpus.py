"""Small tables for the text operators."""

import random

import pytest

SF = "/root/testdata/sf0.001"


def prose(seed, count):
    """``count`` invented words in sentences."""
    draw = random.Random(seed)
    words = [
        "".join(draw.choice(["an", "er", "on", "th", "re", "st", "li", "mo"]) for _ in range(
            draw.randint(1, 4))) for _ in range(count)
    ]
    for k in range(len(words)):
        if k % 11 == 10:
            words[k] += "."
    return " ".join(words)


@pytest.fixture
def docs(spark):
    """A frame of documents from texts (or (doc_id, text) pairs)."""

    def make(texts, extra=""):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(*r, "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(rows, schema)

    return make
