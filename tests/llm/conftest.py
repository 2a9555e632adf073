import duckdb
import pytest

LONG = ("alpha beta gamma delta " * 9000) + "x" * 40_000
COPY = " ".join(f"word{i} and some more of it" for i in range(40))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, near copies, clashing column names."""
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (None, "Only a text without id.", None, None),
        (4, LONG, "de", "b"), (5, COPY, "en", "b"), (6, COPY, "en", "b"), (6, COPY, "en", "b"),
        (7, COPY + " end", "en", "c"), (8, "écrivez à jean.dupont@mail.example ou +1 (555) 010-9999 😀", "fr", "c"),
        (9, "a", "fr", "c"), (10, " 1.2.3.4 \x00 <|endoftext|> 4111 1111 1111 1111", "xx", "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    extra = {
        "n_chars": "CAST(length(text) AS BIGINT)", "key": "1", "h": "2", "block": "3", "_id": "'x'", "_text": "'y'", "kept": "false",
        "n_words": "0", "component_id": "5", "rep": "6", "a": "7", "_gone": "8", "piece": "9", "quality": "1", "features": "'z'",
    }
    return docs.selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def tiny_rows(tiny):
    return duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{tiny}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def tiny_docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")
