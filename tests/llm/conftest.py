import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (3, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t ", "de", "b"),
    (7, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" und der Fluß, 世界 🙂", "de", "a"),
    (None, "null id text with some words in it", "en", "c"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (9, "word " * 30_000, "en", "c"),
    (10, "a", "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, ties, and columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, SCHEMA)
    names = "Size Spans IDS Decoded Shard Slot SCORE Lang_Pred Known Fingerprint H Start S _Key Target more _H _Source N_Blocks _Chunk Bin Parts _parts _text_key Salt Piece Band Keys gone_h Epoch Lo HI Block K Row Whole c0 c_0 Class_ID First"
    return df.withColumns({c: F.lit(7) for c in names.split()})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
