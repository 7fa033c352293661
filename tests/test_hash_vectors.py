"""tokens are hashed and counted in their rows, and only vectors leave the scan."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index


@pytest.mark.parametrize("dimension", [64, 12])
def test_vectors_are_counted_in_their_rows(spark, dimension):
    """Rows of one id are one chunk; null and empty texts are zeros; results are those of a loop."""
    texts = [("a", "The the THE dog_1 số 5"), ("b", None), ("c", ""), ("a", "dog_1 dog_1 😀 x"), ("d", "y " * 5000), (None, "no id")]
    vectors = index.hash_counts(spark.createDataFrame(texts, "chunk_id string, text string"), dimension)
    want = {}
    for key, text in texts:
        vec = want.setdefault(key, [0.0] * dimension)
        for token, n in Counter(t for t in (text or "").split() if t != "😀").items():
            number = int(hashlib.sha1(token.encode()).hexdigest(), 16)
            vec[number % dimension] += -n if number >> 1 & 1 else n
    assert {r.chunk_id: r.vec for r in vectors.collect()} == want
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "sha" not in plan  # no row and no digest in text for every token
    assert index.hash_counts(spark.createDataFrame([], "chunk_id long, text string")).where(F.lit(True)).collect() == []
