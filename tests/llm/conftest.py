"""The parent folder's session, and small documents with every odd case."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "en"),
    (2, "ONE two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "a b", "en"),
    (6, "A  b", "en"),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "en"),
    (7, "x " * 30_000 + "end", "en"),
    (7, "x " * 30_000 + "end", "en"),
    (8, "zz one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen yy", "en"),
    (9, " \n\t tab\x0b\x0c\r ünïcode space 日本 \x00 ", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, ties, repeated rows, very long texts, and columns with clashing names."""
    rows = [(i, t, lang, "s", 0, "clash", 1, True, [1]) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _rejected string, _kept_id int, kept boolean, key array<int>")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
