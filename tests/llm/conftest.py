import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LONG = "word another thing " * 20_000
# (doc_id, text, lang, source): nulls in every column, empty and very long texts, ties and repeated rows.
ROWS = [
    (1, "Alpha beta gamma delta epsilon.", "en", "a"), (2, "ALPHA beta gamma delta epsilon.", "en", "a"), (3, "Ähre ÄHRE", "de", "b"),
    (4, "ähre ähre", "de", "b"), (5, "", "en", "b"), (6, None, None, None), (7, " \t\n ", "en", ""), (8, LONG, "en", "c"), (9, LONG + "end", "en", "c"),
    (10, "same row", "en", "a"), (10, "same row", "en", "a"), (None, "no id here", "en", "a"), (None, None, None, None), (11, "one", "fr", None),
    (12, "a  b   c \n\n d don't 12 <|endoftext|> !!", "en", "d"), (13, "<|endoftext|>", "en", "d"), (14, "one", "fr", "zz"),
]
# Extra columns with names that operators use for themselves.
EXTRA = "hash bytes copies bits key least size bucket cell sub place rank part piece start length ids score block v text_sha256 _stays _row".split()


@pytest.fixture(scope="session")
def edge(spark):
    rows = [r + (None,) + tuple(f"x{i}" for i in range(len(EXTRA))) for r in ROWS]
    fields = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{c} string" for c in EXTRA)])
    return spark.createDataFrame(rows, fields).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
