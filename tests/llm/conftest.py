import pytest


@pytest.fixture(autouse=True, scope="session")
def folders(spark, tmp_path_factory):
    from lumenary.llm.common import scratch
    from lumenary.session import ship

    ship(spark)
    scratch(spark)


@pytest.fixture
def corpus(spark):
    """Rows with nulls, empty and repeated texts, ties, a long text, and columns with clashing names."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            names = ("chunk", "row", "kind", "size", "spans", "ids", "part", "node", "component", "rest", "n_chars")
            df = df.selectExpr("doc_id", "text", *[f"doc_id AS `{n}`" for n in names])
        return df

    return make
