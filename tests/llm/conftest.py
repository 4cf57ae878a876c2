import pytest

LONG = " ".join(f"word{i % 977} tail{i % 31}." for i in range(60_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, root int, text_hash int, stratum int, n int, ids int, label int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with clashing names."""
    extra = ("x", 1, 2, 3, 4, 5, 6, 7)
    rows = [
        (1, None, "en", "a", None, *extra), (2, "", "en", None, 0, *extra), (3, " \n\t ", None, "a", 4, *extra),
        (4, "One two three", "en", "a", 13, *extra), (5, LONG, "de", "b", len(LONG), *extra),
        (6, "the same row of text stands here twice over", "en", "a", 1, *extra), (6, "the same row of text stands here twice over", "en", "a", 1, *extra),
        (None, "the same row of text stands here twice over", "en", "a", 1, *extra), (None, None, None, None, None, *([None] * 8)),
        (8, "emoji \U0001F600 and <|endoftext|> é ñ 日本", "fr", "b", 5, *extra),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/labels.parquet")
