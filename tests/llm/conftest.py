import duckdb
import pytest
from pyspark.sql import functions as F

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns whose names the operators use themselves.
CLASHING = ("key", "at", "node", "row", "shard", "slot", "a", "b", "n", "sig", "set", "spans", "items", "host", "path", "kept", "first",
            "hit", "ids", "u", "range", "ahead", "h", "site", "id", "score", "block", "_size", "_at", "_part", "_here")

SAME = "the same words are written here once more and then again for all to read"

ODD_ROWS = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "word", "en", None, 4), (4, "!!! ... 12", None, "s", 5),
    (5, SAME, "en", "s", 1), (5, SAME, "en", "s", 1), (6, SAME, "en", "s", None), (None, SAME, "en", "s", 1), (None, None, None, None, None),
    (7, "café " * 30_000, "fr", "t", 150_000), (8, "un deux trois quatre cinq six sept huit neuf dix onze", "fr", "t", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys and texts, empty and long texts, repeated rows, and columns with clashing names."""
    df = spark.createDataFrame(ODD_ROWS, DOCS)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet")


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{MEDIUM}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def tests_table(spark):
    return spark.read.parquet(f"{MEDIUM}/benchmark.parquet")


