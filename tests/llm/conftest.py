import pytest

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents frame from (doc_id, text) or (doc_id, text, source) rows, with extra columns whose names clash with outputs."""
    def build(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F
            frame = frame.withColumns({c: F.lit("clash") for c in ("shard", "slot", "copies", "n_words", "kept", "n_removed", "node", "id", "gram", "value")})
        return frame

    return build
