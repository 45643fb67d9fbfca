import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "One two"), (None, "a text without an id but with words enough"), (6, LONG), (6, LONG), (7, LONG + " more"), (8, "é" * 5000), (9, "a.b@" * 3 + "1" * 20_000)]
#: Columns that operators make themselves, as columns of the input.
CLASH = ("n", "score", "prefix", "row_id", "shard", "slot", "spans", "finds", "size", "pos", "node", "group", "block", "component", "vector", "n_lines", "label", "target", "taken")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", None if (i or 0) % 2 else "s") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
