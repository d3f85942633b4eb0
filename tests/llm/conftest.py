import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """Rows to documents (doc_id, text) with columns whose names the operators use themselves."""
    def make(rows, partitions=3):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        return frame.withColumns({c: F.lit(i) for i, c in enumerate(
            ["lang", "source", "kept", "digest", "key", "node", "n", "score", "content", "segment"])})
    return make
