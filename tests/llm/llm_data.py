"""Small documents with the cases every operator has to bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, n long"
EMPTY_TEXTS = (None, "", "   \n\t ")


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    return " ".join(chance.choice("ab cde fgh ijklm nop qrst uvw xyz lorem ipsum dolor sit amet".split()) + str(chance.randrange(300)) for _ in range(words))


def documents(spark, texts, more=()):
    """One row a text with ids from 0, some odd rows, and columns whose names the operators use inside."""
    rows = [(i, t, "en", f"src{i % 7}", len(t) if t else 0, "k", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(more), SCHEMA)


def odd_rows(first: int):
    """Null ids, texts, sources; blanks; a repeated row; a doc_id with two texts."""
    again = (first + 5, "the same row twice over and over again", None, None, None, None, None, None)
    return [
        (None, "a text without an id but with some words in it", "en", "src1", 1, None, None, None),
        *[(first + i, t, None, None, None, None, None, None) for i, t in enumerate(EMPTY_TEXTS)],
        again,
        again,
        (first + 6, prose(901, 30), "en", "src2", 5, "k", 1, 2),
        (first + 6, prose(902, 30), "en", "src2", 5, "k", 1, 2),
        (first + 7, prose(903, 30_000), "en", "src3", 5, "k", 1, 2),
    ]
