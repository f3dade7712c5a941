import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns named as operators name theirs."""
    texts = [None, "", " ", "one", "one", "Ünïcode wörds \U0001f600 here and there", "a b c d e f g h i j " * 400, "x\ny\nz", "tab\tand  spaces \n\n end "]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), "a", "b") for i, t in enumerate(texts * 4)]
    rows += [(None, "no id", None, None, None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
