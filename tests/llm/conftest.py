import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, part int, h long, size string, target double, copies int, fingerprint string, tokens long"


@pytest.fixture
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [
        (1, "The quick brown fox. It jumps over, the lazy dog!\nSecond line here.", "en", "a", 60, "x", 1, 2),
        (2, "The quick brown fox. It jumps over, the lazy dog!\nSecond line here.", "en", "a", 60, "x", 1, 2),
        (2, "The quick brown fox. It jumps over, the lazy dog!\nSecond line here.", "en", "a", 60, "x", 1, 2),
        (3, None, "en", "b", None, None, None, None),
        (4, "", None, None, 0, "", 0, 0),
        (5, "   \n ", "de", "b", 5, "y", 3, 4),
        (6, long, "de", None, len(long), "y", 3, 4),
        (7, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weg", "de", "a", 70, "z", 1, 1),
        (None, "no id here at all", None, "c", 17, "z", 1, 1),
        (8, "12345 !!! ???", "en", "c", 13, "z", 1, 1),
    ]
    return spark.createDataFrame([(*r, "s", 0.5, 3, "f", 9) for r in rows], DOCS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)
