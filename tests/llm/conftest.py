import pyarrow as pa
import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table with columns that clash with the operators' own names."""

    def make(texts, source="s"):
        rows = [(i, t, "en", source, len(t or ""), i, "x") for i, t in enumerate(texts)] if isinstance(texts, list) else [(i, t, "en", source, len(t or ""), i, "x") for i, t in texts.items()]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, code long, key string")

    return make


ODD = [None, "", " \n\t ", "a", "one two", "a b c d e " * 3, "é ü ß 漢字 👍", "x" * 5000, "w " * 3000, "dup dup", "dup dup"]


def column(texts):
    return pa.array(texts, pa.string())
