import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def messy_rows():
    """Nulls everywhere, empty, blank, one-word, odd and very long texts, copies, near copies and repeated rows."""
    rng = random.Random(3)
    words = ["w%d" % rng.randrange(4000) for _ in range(400)]
    near = words[:395] + ["x1", "x2", "x3", "x4", "x5"]
    long = " ".join("Lang%d" % rng.randrange(9000) for _ in range(30_000))
    texts = [None, "", "   \n\t ", "one", "one", "ONE", "two words", " ".join(words), " ".join(words), " ".join(words).upper(), " ".join(near), long, long,
             "é中\U0001f600 z\x00q ▁ a b  c", "x " * 500, "a\n\nb\n c\r\nd\n", "#*$ % & | <>", None]
    rows = [(i, t, None if i % 3 else "en", "s", None if i % 2 else len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, "null id", None, None, None), (None, None, None, None, None), (-5, " ".join(near), None, None, None)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(messy):
    """The messy rows with more columns, named as the operators' own."""
    return messy.selectExpr("*", *[f"'x' AS {c}" for c in (
        "score", "kept", "cid", "_chunk", "_n", "size", "shard", "slot", "length", "piece", "bands", "ids", "root", "rep", "n_words", "component_id",
        "start", "law", "grown_shard", "license", "sketch", "n", "key", "_name", "held_out", "predicted", "sequence_id", "offset", "_rank")])
