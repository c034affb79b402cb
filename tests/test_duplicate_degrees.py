"""Only documents that share a pair of keys get rows for sets of keys; degrees as by brute force."""

import datetime
import random
from decimal import Decimal

from paperloom.operators import validation


def test_degrees_and_rows(spark):
    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    rows = [(i, pick(None, "", "A", f"N{i}"), pick("s1", "s2", "s3", f"s{i}"), pick(None, datetime.date(2024, 1, 1 + i % 5)), pick(None, "c1", "c2", f"c{i}"), pick(None, Decimal(rng.randint(995, 1005)) / 1000, Decimal(i * 7))) for i in range(60)]
    rows += [(100 + i, f"X{i}", f"y{i}", datetime.date(2030, 1, 1 + i), f"z{i}", Decimal(1000 + i)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, invoice_number string, supplier_name string, invoice_date date, customer_name string, amount_ttc decimal(18,3)")

    def shared(a, b):
        return sum(x == y and x not in (None, "") for x, y in zip(a[1:5], b[1:5])) + (a[5] is not None and b[5] is not None and abs(a[5] - b[5]) <= Decimal("0.01"))

    best = {a[0]: max(shared(a, b) for b in rows if b is not a) for a in rows}
    want = {k: n for k, n in best.items() if n >= 2}
    assert {r[0]: r[1] for r in validation.duplicate_degrees(df).collect()} == want
    met = {r[0] for r in validation.shared_pairs(df).collect()}
    assert set(want) <= met and not met & set(range(100, 109))
