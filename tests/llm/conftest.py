from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, texts without letters, and columns that clash with outputs."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"word{i % 977} runs" for i in range(20_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, "   \n\t", "en", "b"),
        (5, "12 34 !!", None, "b"),
        (6, long_text, "en", None),
        (7, "Der schnelle braune Fuchs springt über den faulen Hund und läuft", "de", "c"),
        (8, "x", "de", "c"),
        (None, "no id but some words in here", "en", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    clash = {c: F.lit("clash") for c in ("Score", "predicted", "lang_pred", "shard", "Slot", "copies", "size", "offset", "sequence_id", "host", "path", "rule", "verdict", "piece", "bands")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
