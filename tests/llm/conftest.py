import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 66),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 66),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 66),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n", "en", "b", 3),
        (6, long, "en", "c", len(long)),
        (None, "no id here, but a text of some words all the same", "de", None, 49),
        (7, "same line\nsame line\n\nother ß 😀 line", "de", "c", 34),
        (8, 'token = "abcdef0123456789abcdef0123456789abcdef01" and words', None, "b", 60),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("size", "key", "fp", "component_id", "file", "part", "a", "b", "n", "host", "node", "root", "_id_", "_text_", "_size", "_key", "_pattern", "_id", "_tail", "gone_id", "mark")}
    return spark.createDataFrame(rows, cols).withColumns(clash)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
