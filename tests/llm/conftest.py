import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, key string, shard int, _part int"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 997} été{i}" for i in range(20_000))
    extra = (0.5, 1, "k", 3, 4)
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, *extra),
        (1, "one two three four five six seven", "en", "a", 33, *extra),
        (2, None, "en", None, None, *extra),
        (3, "", None, "b", 0, *extra),
        (4, " \n\t ", "en", "b", 4, *extra),
        (None, "a text without an id", None, None, None, *extra),
        (None, None, None, None, None, None, None, None, None, None),
        (5, long, "fr", "c", len(long), *extra),
        (6, long + " and one more", "fr", "c", len(long) + 13, *extra),
        (7, "x" * 5_000, "en", "a", 5_000, *extra),
        (8, "ONE two\nthree four five  six seven", "en", "d", 33, *extra),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def stored_odd(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    odd.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0, "x"), (1, 1, 0, "x"), (5, 0, 1, "y"), (6, 0, 1, "y"), (7, 1, None, None), (None, 1, 1, "z"), (8, None, 0, "z"), (3, 1, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
