import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that operators must take in their stride: nulls in every column, empty and white texts, repeats, ties,
#: a very long text, text beyond the basic plane.
LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (None, "the same words again and again for a null id", "en", "s", 1),
    (1, None, "en", "s", None),
    (2, "", "en", None, 0),
    (3, " \t\n\x0b\f\r ", None, "s", 7),
    (4, "one", "en", "s", 3),
    (5, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "s", 69),
    (5, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "s", 69),
    (6, "The QUICK brown fox jumps over the lazy dog near the river bank today", "en", "t", 69),
    (7, LONG, "la", "s", len(LONG)),
    (8, "😀 𝒳 ́combining Straße İstanbul 中文 字符", "xx", "s", 30),
    (9, "x" * 120_000, None, None, 120_000),
    (10, "1 " * 50_000 + "@" * 1000 + "+1" + "(" * 1000, "en", "s", 1),
]
#: Columns that an operator also uses inside or returns.
CLASHES = ["ids", "start", "length", "spans", "score", "node", "set_key", "component_id", "kept", "words", "n_words", "hash", "share", "rank", "label", "prefix", "term", "held_out"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(f"clash {c}") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
