from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own or their results' columns.
CLASHING = ["size", "shard", "slot", "fp", "key", "id", "th", "n", "bucket", "score", "lang_pred", "fingerprint", "component_id", "leaks", "n_tokens",
    "kept_text", "n_removed", "license", "own_license", "taken", "target", "cid",
    "c0", "c1", "in0", "uid", "at", "dealt", "hot_n", "words", "sketch", "body", "cut", "__cut", "__fp", "__id", "__bucket", "__tie", "rows", "run", "rn", "a", "b", "x", "y", "no", "whole", "dir", "own", "number"]


@pytest.fixture(scope="session")
def documents(spark):
    if not Path(f"{DATA}/documents.parquet").exists():
        pytest.skip("the supplied tables are not here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def words(n, start=0):
    return " ".join(f"word{k}" for k in range(start, start + n))


EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", None, 3), (None, words(80), None, "a", 5), (None, words(80), None, "a",
        5), (None, None, None, None, None),
    (7, words(80), "en", "b", 1), (7, words(80), "en", "b", 1), (8, words(90), "fr", "b", 1), (9, words(60, 500), "de", "c", 1), (9, words(61, 500),
        "de", "c", 1),
    (10, "x" * 300_000, "en", "a", 300_000), (11, words(40_000), "en", "a", 1), (12, "ünï\0cödé " * 100, "de", "c", 1), (13, "1234 5678", None, "a",
        9), (-5, words(80), "en", "z", 1),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls everywhere, blank and very long texts, repeated rows, ties, and columns with clashing names."""
    frame = spark.createDataFrame(EDGES, COLUMNS).repartition(3)
    for k, name in enumerate(CLASHING):
        from pyspark.sql import functions as F

        frame = frame.withColumn(name, F.lit(str(k)))
    return frame


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("1 = 0")
