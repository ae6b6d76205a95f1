import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType  # noqa: E402

from opsloom.llm import queries  # noqa: E402
from opsloom.session import ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"

# Extra columns whose names the operators use inside.
DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        StructField("key", StringType()),
        StructField("size", DoubleType()),
        StructField("print", StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, source]) as a documents table with clashing extra columns."""
    ship_package(spark)

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "k", 1.0, None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def run(spark):
    return lambda name, folder=SMALL: queries.QUERIES[name](spark, folder)


HARD = [
    (0, "One two three four five six seven eight nine ten."),
    (1, "One two three four five six seven eight nine ten."),
    (2, " One\ttwo three\nfour five six seven eight nine ten. "),
    (3, "one two three four five six seven eight nine ten!"),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "x"),
    (8, "é ü 😀   naïve   z"),
    (9, "aaaa " * 4000),
    (10, "aaaa " * 3999 + "aaab "),
    (11, None),
    (None, "no id"),
    (12, "no id"),
    (13, "word"),
    (13, "word"),
    (14, "a\x00b"),
]
