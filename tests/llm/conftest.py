import pytest

#: Rows that every operator must take: null, empty, blank, repeated, long, non-ASCII and control characters.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, "The  quick brown fox\tjumps over the lazy dog.\n"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r"),
    (None, "a row without an id"),
    (None, None),
    (7, "repeated row"),
    (7, "repeated row"),
    (8, "Größe 東京 \U0001f600 é    it's we'll 'tis \x00\x1c 12½ ٣"),
    (9, "word " * 30000),
    (10, "x" * 5000),
    (11, "The quick brown fox jumps over the lazy cat."),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """With columns named as the operators' own."""
    rows = [(i, t, "s", "s", 1, 0.5, True, 3) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key long")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
