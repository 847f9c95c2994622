import pytest

from failsift.llm.tables import small_batches


@pytest.fixture(autouse=True)
def batches(spark):
    small_batches(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, source) rows, with columns that clash with names used inside."""

    def make(rows):
        rows = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        schema = "doc_id long, text string, source string"
        given = spark.createDataFrame(rows, schema)
        extra = ("lang", "n_chars", "score", "label", "size", "target", "words", "part", "kind", "copies", "key", "id")
        return given.selectExpr("*", *[f"'x' AS {name}" for name in extra])

    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS id")

    return make
