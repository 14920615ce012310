import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "one", "en", "b"), (5, "one two", "en", "b"), (6, "one two", "en", "b"),
    (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40, "en", "a"), (8, "A B C d e f g h i j k l m n o p q r s t u v w x y z " * 40, "en", "a"),
    (9, "É é ß 日本語   x\u0085y", "fr", "c"), (None, "no id here", "en", None), (10, "word " * 30000, "en", "a"), (11, "same", "en", "a"), (11, "same", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns under clashing names."""
    rows = [(*r, "x", "y", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, part string, size int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
