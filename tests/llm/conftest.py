import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, source), with a column more than the real ones."""
    from pyspark.sql import functions as F

    def make(rows, parts=3):
        full = [(i, t, "en", s[0] if s else "s", len(t or "")) for i, t, *s in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(parts).withColumn("size", F.lit("a clashing name"))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "null id"), (None, None), (6, long), (7, "two words"), (8, "ünï cödé ½ 漢字")]
