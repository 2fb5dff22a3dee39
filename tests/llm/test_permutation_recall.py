"""Recall against brute force at the share that is multiplied out, over table and block sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import permutation_index
from lexiloom.llm.permutation_index import permutation_search, reranked


def test_reranked_is_one_rule():
    assert [reranked(n, 20, 1 / 8) for n in (100, 500, 2000, 2048, 10_000, 32_768)] == [100, 223, 410, 416, 1410, 4256]
    sizes = [reranked(n, 20, 1 / 8) for n in range(1, 5000)]
    assert all(0 <= b - a <= 1 for a, b in zip(sizes, sizes[1:], strict=False))


@pytest.mark.parametrize(
    ("table", "small", "every"), [("sf0.001", 2048, 20), ("sf0.1", 2048, 20), ("sf0.1", 500, 20), ("check_s", 2048, 100), ("check_l", 2048, 500)]
)
def test_recall(spark, monkeypatch, table, small, every):
    monkeypatch.setattr(permutation_index, "SMALL_BLOCK", small)
    rows = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    frame = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).toPandas().dropna()
    kept = [(i, np.array(e, float)) for i, e in zip(frame["vec_id"], frame["e"], strict=True)]
    kept = [(i, e) for i, e in kept if len(e) and np.isfinite(e).all() and e.any()]
    ids, x = np.array([i for i, _ in kept]), np.stack([e for _, e in kept])
    found = permutation_search(rows, F.col("vec_id") % every == 0).toPandas()
    hit = total = 0
    for q, g in found.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g["vec_id"]))
        total += 20
    blocks = max(-(-len(x) // 32_768), min(4, -(-len(x) // small)))
    size = len(x) // blocks
    print(table, len(x), blocks, reranked(size, 20, 1 / 8) / size, hit / total)
    assert total and hit >= 0.93 * total
