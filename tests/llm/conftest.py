import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def frame(spark):
    """A documents frame of (doc_id, text) pairs, with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        clashing = ("h", "did", "th", "node", "key", "marks", "kept", "score", "values", "fresh", "parts", "n", "set", "th_", "__did", "__th", "__kept", "__n_text", "__values_text", "kept_", "_did", "_kept")
        return df.withColumns({c: F.lit("clash") for c in clashing})

    return make
