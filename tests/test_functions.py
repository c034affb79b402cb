"""Edge cases of the scalar functions and rules."""

import datetime

from pyspark.sql import functions as F

from paperloom.functions import numbers as N
from paperloom.functions import text as T
from paperloom.operators import evaluation as E
from paperloom.operators import validation as V


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_amounts(spark):
    texts = ["104.751 TND", "1.810.576", "1 234,56", "1,234.56", "1,000", "-5,5", "1,234,567", "abc", "", None, "1-2", "١٢,٥", ".5", "12."]
    want = [104.751, 1810.576, 1234.56, 1234.56, 1.0, -5.5, 1234.567, None, None, None, None, 12.5, 0.5, 12.0]
    assert [None if v is None else float(v) for v in one(spark, N.amount, *texts)] == want


def test_dates(spark):
    day = datetime.date(2026, 5, 6)
    assert one(spark, N.day_first, "06/05/2026", "2026-05-06", "6 mai 2026", "Date: 6 May 2026", "31/02/2026", "none", None) == [day, day, day, day, None, None, None]


def test_texts(spark):
    assert one(spark, T.without_repeats, "a a b b a", "", None) == ["a b a", "", None]
    assert one(spark, T.without_legal_form, "acme trading co ltd inc", "ltd", "sarl acme") == ["acme trading co", "", "sarl acme"]
    assert one(spark, T.without_role_label, "bill to acme", "client", "clients") == ["acme", "", "clients"]
    assert one(spark, T.letter_digit_fixed, "INV-O01", "1I2", "OI") == ["INV-001", "112", "OI"]
    assert one(spark, T.is_placeholder, "TODO", "N/A", "real", None) == [True, False, False, False]
    assert one(spark, T.description, "01 Steel bolt", "12", " | Pipe -") == ["Steel bolt", None, "Pipe"]
    assert one(spark, T.is_meaningful, "abc", "acme", "group", "acme tools") == [False, True, False, True]
    assert one(spark, N.truthy, "Yes", " on ", "0", None) == [True, True, False, False]
    assert one(spark, N.currency, "€", "us$", "dirham", "", None) == ["EUR", "USD", "DIR", None, None]


def test_rows(spark):
    rows = spark.createDataFrame([(1, "bolt", "2", "10", "20"), (2, "bolt", "2", "10", None), (3, "bolt", "2", "10", "99"), (4, "", "1", "1", "1"), (5, "bolt", "-1", "10", "-10")], "doc_id long, description string, q string, p string, t string")
    items = rows.select("doc_id", "description", F.col("q").cast("decimal(12,3)").alias("quantity"), F.col("p").cast("decimal(12,2)").alias("unit_price"), F.col("t").cast("decimal(18,3)").alias("line_total_ht"), F.lit(None).cast("decimal(6,2)").alias("tax_rate"))
    got = {r["doc_id"]: r["row_status"] for r in V.check_rows(items).collect()}
    assert got == {1: "validated", 2: "needs_review", 3: "invalid", 4: "needs_review", 5: "invalid"}


def test_latest_wins(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, None)], "document_id long, log_seq long, execution_status string")
    assert sorted(map(tuple, E.latest_attempts(rows).collect())) == [(1, 9, "b"), (2, 1, None)]
