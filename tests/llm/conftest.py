import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(20_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", "s", 3), (5, "one\n", "en", None, 4),
    (6, "One two three four five six", None, "s", 27), (6, "One two three four five six", None, "s", 27), (None, "no id here", "en", "s", 10),
    (7, "größe ẞ İ 日本語 \x1c 👍🏽 <|endoftext|> </turn> \\", "de", "s", None), (8, LONG, "en", "s", len(LONG)), (9, LONG + " x", "en", "s", len(LONG) + 2),
    (10, "A" * 30_000, "en", "s", 30_000), (11, "!!! ### $$$ " * 400, "en", "s", 4800),
]
#: Names that clash with those that operators use themselves.
EXTRA = ("key", "part", "row", "h", "fp", "shard", "id", "a", "b", "node", "root", "count", "line", "word", "ids", "y", "length")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, ties, repeats and clashing columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}
