import random

import pytest

CLASHING = "doc long, row long, h long, name string, place int, region long, block long, key long, host string, n long, words string, site string"


def invented(seed, n, ending="."):
    """n words of made-up text, sentences of six words, lines of three sentences."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ba", "ko", "ri", "tu", "me", "la"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        end = ending if i % 6 == 5 else ""
        out.append(w + end + ("\n" if i % 18 == 17 else " "))
    return "".join(out)


@pytest.fixture
def make_docs(spark):
    """(doc_id, text) or (doc_id, text, source) rows as documents, with extra columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None, *[None] * 12) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")

    return build


@pytest.fixture
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = invented(7, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, long), (5, long), (None, long), (None, None), (6, "a b"), (7, "a b"), (8, invented(8, 200), None)]
