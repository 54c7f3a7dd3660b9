import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
for p in (str(ROOT), str(ROOT / "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    long_text = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, None), (4, long_text, "en", "b", len(long_text)),
        (5, "One two three.", "en", "b", 14), (5, "One two three.", "en", "b", 14), (None, "No id here, but words.", "fr", "c", 22),
        (6, "é Straße ŒUVRE \U0001f600 x", "fr", "c", 18), (7, "a" * 200_000, "en", "c", 200_000),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    clash = {c: F.lit(i) for i, c in enumerate(["score", "kept", "spans", "redacted", "leaks", "ids", "n_words", "path", "key", "h1", "row"])}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
