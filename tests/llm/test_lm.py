"""The language model learns the same whatever the partitions are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.llm import lm


@pytest.mark.parametrize("worker", [lm.WORKER, 2_000])
def test_scores_do_not_hang_on_partitions(spark, monkeypatch, worker):
    monkeypatch.setattr(lm, "WORKER", worker)
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(300)])
    rows = [(i, " ".join(words[np.minimum(rng.zipf(1.4, rng.integers(1, 90)), 300) - 1])) for i in range(400)] + [(7, None), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for n in (1, 5):
        found = lm.score_documents(docs.repartition(n, F.xxhash64("text")))
        got.append(np.array([r.score for r in found.orderBy(F.col("doc_id"), "n_tokens", "base_score").collect()]))
    assert len(got[0]) == len(rows)
    assert np.allclose(got[0], got[1], rtol=1e-4)


def test_workers_follow_the_tokens(spark, monkeypatch):
    """Many workers still learn: their average is nearer the words than counts alone."""
    monkeypatch.setattr(lm, "WORKER", 4_000)
    text = " ".join(["the quick brown fox jumps over the lazy dog"] * 6)
    docs = spark.createDataFrame([(i, text) for i in range(900)], "doc_id long, text string")
    found = lm.score_documents(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert found.s > 0.8 * found.b
