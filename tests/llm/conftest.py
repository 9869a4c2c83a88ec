import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, rid int, row int, fp int, size int, host int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty, blank, one-line and very long texts, repeated
    rows, and further columns with names that the operators use inside."""
    passage = "\n".join(f"line {i} of a passage that two documents share" for i in range(12))
    texts = [
        (1, "The cat and the dog of the house sat on the mat and then ran away.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "de", "b"),
        (5, "Der Hund und die Katze sind in dem Haus und nicht auf der Wiese.", "de", "b"),
        (6, f"one\ntwo\n{passage}\nend of six", "en", "a"),
        (7, f"first of seven\n{passage}\nthree\nfour\nfive", "en", "c"),
        (8, "ab cd " * 40_000, "en", "a"),
        (9, "x" * 200_000, None, "c"),
        (10, "12345 67890 !!", "en", None),
        (11, "word", "en", "a"), (11, "word", "en", "a"), (11, "word", "en", "a"),
        (12, "'s 'll\u3000don't  WON'T\u00e9\u4e2d\U0001f600 \r\n", "fr", "b"),
        (None, "no key here", "en", "a"),
        (13, "Der Hund und die Katze sind in dem Haus und nicht auf der Wiese.", None, "b"),
    ]
    return spark.createDataFrame(
        [(k, t, l, s, None if t is None else len(t), "k", 1, 2, 3, 4, 5) for k, t, l, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
