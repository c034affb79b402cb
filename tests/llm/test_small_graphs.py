"""What one task can hold is grouped and solved without shuffles."""

import pytest

from paperloom.llm import common, components, jaccard


@pytest.mark.parametrize("alone", [1 << 20, 7])
def test_components_of_chains_and_stars(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "ALONE", alone)
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100)]
    star = [(500, x) for x in range(200, 240)] + [(239, 300), (260, 239)]
    edges = spark.createDataFrame(chain + star, "u long, v long").repartition(5)
    want = {u: 0 for u in range(1, 41)} | {u: 200 for u in (*range(201, 240), 260, 300, 500)}
    assert dict(map(tuple, components.components(edges).collect())) == want


def test_few_rows_need_no_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 7 as cell", "id as a").repartition(5)
    small = common.few(common.cut(rows, "rows"))
    plan = small.groupBy("cell").count().join(small, "cell")
    assert len(plan.collect()) == 1000
    assert "Exchange hash" not in plan._jdf.queryExecution().executedPlan().toString()
    common.release(small)
    assert small not in common._PATHS


def test_pairs_are_grouped_without_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    made = []
    monkeypatch.setattr(jaccard, "cut", lambda df, name: made.append(df) or df)
    pairs = spark.createDataFrame([(x, x // 3) for x in range(1, 90)], "a long, b long").repartition(5)
    got = jaccard._grouped(pairs).collect()
    assert sorted((r.a, r.b) for r in got) == [(x, x // 3) for x in range(1, 90)]
    assert "Exchange hash" not in made[0]._jdf.queryExecution().executedPlan().toString()
