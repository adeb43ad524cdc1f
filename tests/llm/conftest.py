import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and extra columns with working names."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, " \n\t ", "en", "src0", 3), (4, long_text, "en", "src0", 1), (5, long_text, None, "src1", 1),
            (6, "one two three", "en", "src1", 1), (6, "one two three", "en", "src1", 1), (None, "one two three", "de", "src1", 1), (None, None, None, None, None),
            (7, "One Two\tthree", "de", None, 1), (8, "é ü 漢字 😀 a b c d", "fr", "src2", 1), (9, "7" * 5_000, "en", "src2", 1), (10, "a" * 5_000 + "@", "en", "src2", 1),
            (11, "....,,,;;;", "en", "src2", 1), (12, "x " * 30_000, "en", "src2", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("doc", "id", "key", "keys", "print", "component", "tokens", "shard", "size", "spans", "start", "score", "_text", "_bucket", "page", "hashes"):
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
