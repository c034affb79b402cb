"""Queries whose vec_id stands on many rows, and queries dealt over slices."""

import numpy as np

from paperloom.llm import topk


def test_topk_query_on_many_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i + 1, [float(x) for x in rng.normal(0, 0.1, 4)]) for i in range(48)] + [(50, [4.0, 0.0, 0.0, 0.0])] * 12 + [(51, [1.0, 0.0, 0.0, 0.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows]
    x = good[48][1]
    want = [(50, n, i, -s) for n, (s, i) in enumerate(sorted((-int(x @ y), i) for i, y in good if i != 50)[:5], 1)]
    assert sorted(map(tuple, topk.top_k(df, pivots=51, rings=3).collect())) == want


def test_topk_slices_of_queries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, topk.top_k(df, every=3, pivots=7).collect()))
    assert whole == sorted(map(tuple, topk.top_k(df, every=3, pivots=7, query_rows=4).collect()))
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows}
    want = [(q, n, i, -s) for q in good if q % 3 == 0 for n, (s, i) in enumerate(sorted((-int(good[q] @ y), i) for i, y in good.items() if i != q)[:5], 1)]
    assert whole == sorted(want)
