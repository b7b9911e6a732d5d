import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# nulls in every column, empty and blank texts, ties and repeated rows, a very long
# text, and columns whose names clash with names that the operators use inside
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 45),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 45),
    (2, "alpha beta gamma delta epsilon zeta eta theta", None, None, None),
    (3, None, None, None, None),
    (None, "mail me at jo.doe@mail.example.com or +1 (555) 010-9999", "en", "s", 1),
    (None, None, None, None, None),
    (4, "", "", "", 0),
    (5, " \n\t ", "en", "s", 4),
    (6, "word " * 60_000, "en", "s", 300_000),
    (7, "a" * 50_000, "en", "s", 50_000),
    (8, "Ünïcode 漢字 😀 text", "xx", "s", 17),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, DOCS).repartition(3, "doc_id")
    for name in ("key", "content", "node", "_row", "block", "score", "start", "_id", "word"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")
