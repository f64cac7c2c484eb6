import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, so that clashes would show.
ODD = "a bigint, b bigint, id bigint, n bigint, `_drops` string, kept string, shard int, size string, word string, row int"


def edge_rows():
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows, odd characters."""
    long = "\n".join(f"line number {i} of a text that goes on and on" for i in range(3000))
    shared = "This line stands in many documents of all hosts."
    body = " ".join(f"word{i}" for i in range(70))
    return [
        (1, body, "en", "a", 1), (2, body, "en", "a", 1), (2, body, "en", "a", 1), (3, body + " more", "de", "b", None),
        (4, "", "en", "a", 0), (5, None, None, None, None), (6, "   \n\t\r\n ", "en", "a", 3), (7, long, "en", "c", 5),
        (8, shared + "\nown line number one here", "en", "a", 2), (9, shared.upper() + "  \nanother", "en", None, 2),
        (10, "short", "en", "a", 5), (11, "a b c a b c a b c " * 20, "en", "a", 1), (12, "Ünïcode 漢字 🙂 text with separators", "en", "a", 1),
        (None, body, None, None, None), (None, shared, "en", "a", 1), (13, long + " tail", "en", "c", 5), (14, "x" * 50_000, "en", "d", 1),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """The edge rows with columns that clash with inner names, and in another order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for name in ("id", "n", "a", "b", "mark", "_drops", "_owner", "kept", "shard", "size", "row", "bucket", "h1", "line", "lost"):
        df = df.withColumn(name, F.lit("clash"))
    return df.select(*reversed(df.columns))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
