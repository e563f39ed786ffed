import random

import pytest

DOCS = "doc_id long, text string, component_id string, fingerprint int, id string"


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, the same at each run."""
    draw = random.Random(3)
    syllables = ["ba", "ko", "li", "mer", "su", "tan", "vi", "zor", "pel", "gra"]
    words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(3_000)]

    def make(n: int) -> str:
        return " ".join(draw.choice(words) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Makes a documents table whose other columns are named like the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Null, empty and blank texts, null and repeated ids, repeated rows, one very long text."""
    long = prose(60_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One word"), (None, "no id"), (5, prose(300)), (5, prose(200)),
        (6, "same same same"), (6, "same same same"), (7, long), (8, "Zürich déjà vu 東京 \U0001f600 ΑΣ ΣΑΣ İ e\u0301"),
        (9, "a\u00a0b\u2003c\x1cd\x85e"), (10, "<|endoftext|> and <|EndOfText|>")]
