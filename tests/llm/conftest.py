import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a null and a repeated id, repeated rows, a long text, and columns
    whose names clash with the operators' own."""
    rows = [
        (1, "one two three four five", "en", "a", 23),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "a", 4),
        (5, "one two three four five", "en", "a", 23),
        (5, "one two three four five", "en", "a", 23),
        (6, "word " * 40_000, "fr", "b", 200_000),
        (None, "no id here at all", "de", "b", 17),
        (7, "x" * 30_000, None, "b", 30_000),
    ]
    df = spark.createDataFrame(rows, DOCS)
    names = ("shard", "slot", "fp", "text_hash", "hash", "gram", "term", "part", "order", "toxic", "row", "id", "none", "key", "cell", "p", "pos", "first", "root", "a.b", "a`b", "sketch", "fold", "weight", "place")
    names += ("__p", "__key", "__order", "__at", "__pos", "__shard", "__cell", "__rank", "__start", "__bounds", "__id", "__none", "__hash", "__bad_id", "__bad_hash")
    for name in names:
        df = df.withColumn(name, F.lit(name)) if "." not in name and "`" not in name else df.select("*", F.lit(name).alias(name))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
