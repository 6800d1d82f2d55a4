import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Nulls, empty, blank and very long texts, repeated rows and ids, and columns whose
    names operators use themselves."""
    long_text = " ".join(f"word{i % 977} and line{i}" + ("\n" if i % 20 == 0 else "") for i in range(60_000))
    same = "the very same line of text that several rows have word for word\nand a second line that they share as well"
    rows = [
        (None, None, None, None, None),
        (None, same, "en", None, 5),
        (1, None, "en", "s", None),
        (2, "", None, "s", 0),
        (3, "   \n\n \t", "en", "s", 7),
        (4, same, "en", "s", len(same)),
        (4, same, "en", "s", len(same)),
        (5, same, "en", "s", len(same)),
        (5, "another text under an id that is used already, with enough words in it", "en", "s", 70),
        (6, long_text, "en", "s", len(long_text)),
        (7, "x" * 200_000, "en", "s", 200_000),
        (8, "word", "en", "s", 4),
        (9, "!!! ??? ...", "en", "s", 11),
        (10, "İstanbul ǅ ß ﬁ 北京大学 \U0001f600 é", "tr", "s", 20),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in ("fp", "sketch", "id", "doc", "line", "gone", "h1", "bin", "rank", "group", "shard", "bucket", "keep_id", "score", "class", "html", "digest")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
