"""Shards and blocks of queries meet by key, whatever their sizes."""

import numpy as np
from pyspark.sql import functions as F

from argloom.llm import impact_search


def test_shards_meet_queries_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "SHARD", 40)
    monkeypatch.setattr(impact_search, "QUERY_BLOCK", 4)
    x = np.random.default_rng(5).integers(-1000, 1000, (300, 8))
    vectors = spark.createDataFrame([(i, [v / 1024 for v in r]) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    out = impact_search.top_k(vectors, F.col("vec_id") % 5 == 0, 3)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(q, r + 1, v, int(x[q] @ x[v])) for q in range(0, 300, 5) for r, v in enumerate(sorted(set(range(300)) - {q}, key=lambda v: (-int(x[q] @ x[v]), v))[:3])}
    assert {tuple(r) for r in out.collect()} == want
