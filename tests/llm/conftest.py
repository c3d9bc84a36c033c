import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))

#: Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use.
ROWS = [
    (1, "", "en", "a", 0),
    (2, None, None, None, None),
    (None, "Null id here, of a few words.", "en", "a", 3),
    (3, LONG, "en", "b", len(LONG)),
    (4, "The same text twice over.", "en", "b", 5),
    (4, "The same text twice over.", "en", "b", 5),
    (5, "The same text twice over.", "fr", "c", 5),
    (6, "  \n\t ", "en", None, 2),
    (7, "é ü 漢字 <|endoftext|> it's\x1cdon't x 😀 password=abcdefghijkl0123", "de", "a", 9),
    (-50, "one", "en", "a", 3),
]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["ids", "rank", "start", "size", "rid", "hash", "n", "key", "score", "kept_text", "at", "base", "position"]
    return frame.withColumns({c: F.lit("x") for c in clash}).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
