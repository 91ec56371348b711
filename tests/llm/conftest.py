import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with every awkward case: nulls, empties, repeats, clashing extra columns, one very long text."""
    prose = "The river ran past the old mill and the children threw stones at it until evening came. " * 2
    varied = " ".join(f"word{i} goes{i % 7} here{i % 11}" for i in range(120))
    rows = [
        (1, prose, "en", "a", 1), (2, prose, "en", "a", 1), (2, prose, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "a null id has words", None, "b", 5),
        (5, "   \t\n ", None, None, 3), (6, varied, "en", "b", 9), (7, varied.replace("word5 ", "changed "), "en", "c", 9), (8, "Ünïcödé wörds 日本語 😀 " * 30, "de", "c", 4), (9, varied * 200, "en", "a", 7), (10, "one", "en", "c", 3),
    ]
    from pyspark.sql import functions as F

    base = spark.createDataFrame(rows, DOCS)
    return base.select("*", *[F.lit(7).alias(c) for c in ("size", "score", "fp", "ids", "h", "b", "source_size", "part", "prompt", "held_out")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
