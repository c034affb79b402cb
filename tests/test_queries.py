"""Every registered query against its SQL counterpart in DuckDB."""

import decimal
import math
import os

import duckdb
import pytest

from paperloom import plans
from paperloom.plans import fixtures

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def shared_views(spark):
    fixtures.keep(spark, SF, "line_items_tax", "invoices", "lines", "ocr_lines", "runs", "field_rows", "proposals", "candidates", "items_full", "strategy_rows")
    yield
    for df in fixtures._KEPT.values():
        df.unpersist()
    fixtures._KEPT.clear()


def canonical(rows):
    def value(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted(([value(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = canonical(map(tuple, df.select(*cols).collect()))
    if name not in plans.SQL:
        assert got
        return
    result = duck.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == canonical([[r[i] for i in order] for r in result.fetchall()])
