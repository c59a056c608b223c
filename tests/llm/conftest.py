import pytest

LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(30_000))

DOCUMENT_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5, "x", 1),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5, "x", 1),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, "x", 2),
    (4, "   \n\t ", "en", "b", 6, "x", 2),
    (None, "a text without an id that is long enough to count for something", "en", "a", 5, "y", 3),
    (5, "one", "en", None, 3, "y", 3),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "c", 5, "x", 1),
    (7, LONG, "en", "c", len(LONG), "z", 9),
    (8, LONG + " tail", "en", "c", len(LONG) + 5, "z", 9),
    (9, "naïve Ünïcode Σίσυφος 文字 <|endoftext|> \x1d odd", "xx", "c", 30, "z", 9),
]
#: score, key, block, id and slot clash with names that operators use inside or return
DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, block int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(DOCUMENT_ROWS, DOCUMENT_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT_SCHEMA)


@pytest.fixture(scope="session")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.95, 0.1, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]),
            (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]),
            (9, [-1.0, 0.5, 0.25]), (10, [0.0, -1.0])]
    return spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")


@pytest.fixture(scope="session")
def no_vectors(spark):
    return spark.createDataFrame([], "vec_id long, embedding array<float>")
