from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def words():
    """Random words, seeded."""

    def make(n: int, seed: int, letters: str = "abcdefgh") -> list[str]:
        draw = random.Random(seed)
        return ["".join(draw.choice(letters) for _ in range(draw.randint(1, 7))) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of (doc_id, text, lang, source, n_chars) and columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, class string, key string, size string, block string, row string, token string"

    def build(rows):
        full = [(i, text, "en", source, None if text is None else len(text), "c", "k", "s", "b", "r", "t") for i, text, source in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and blank texts, repeated rows, a long text, special strings, broken lines."""
    long = " ".join(words(6000, 5))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "a"), (4, "one", "a"), (None, "one two three", "a"), (None, None, None),
        (5, long, "b"), (6, long, "b"), (7, "x" * 3000, "b"), (8, "tail <|endoftext|> and <s>  more\n\nlines \u00e9\u4e2d\U0001f600 1234's", "c"),
        (9, "the same line here\n" * 30, "c"), (10, " ".join(words(300, 9)), "d"),
    ]
