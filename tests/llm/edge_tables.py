from __future__ import annotations

import pytest

EDGE = [  # null, empty, blank, short, long, ties, repeated rows, null id
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3),
    (4, "one two", "en", "a", 7), (5, "one two", "en", "b", 7), (6, "word " * 30_000, "xx", "b", 150_000),
    (7, "Ünï ćödé ﷽ 漢字 😀 text", "fr", "b", None), (7, "Ünï ćödé ﷽ 漢字 😀 text", "fr", "b", None),
    (None, "a row without an id that has a few more words", "en", "a", 45),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Odd rows, with columns whose names operators use inside."""
    extra = " ".join(f", '{c}' as {c}" for c in ("id", "n", "cls", "row", "score", "parts", "rid", "key", "y", "_id", "_key", "_source", "_n", "_parts", "_cdf",
                                                  "_copy", "_redacted", "copy", "new", "source2", "h", "view", "sure", "plain", "name", "cdf"))
    spark.createDataFrame(EDGE, SCHEMA).createOrReplaceTempView("edge_docs")
    return spark.sql(f"select * {extra} from edge_docs")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf="sf0.001": spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
