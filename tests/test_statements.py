"""Statements on small inputs with results worked out by hand: wordings,
nulls, ties, edges of thresholds."""

from decimal import Decimal

import pytest

from paperloom.functions import numbers as N
from paperloom.functions import text as T
from paperloom.functions.predicates import with_predicates
from paperloom.operators import fields, layout, matching, parties, quality, reports, spatial, validation
from paperloom.operators.extraction import classify, contained
from pyspark.sql import functions as F

LINE = "doc_id long, page_number int, line_index int, text string, confidence decimal(4,2), x1 int, y1 int, x2 int, y2 int, page_width int, page_height int"


def named(module, name):
    return next(s for s in module.STATEMENTS if s.name == name)


def lines(spark, *rows):
    """Lines of document 1: (text,) or (text, x1, y1) or (text, x1, y1, page)."""
    full = []
    for i, r in enumerate(rows):
        x, y, page = (list(r[1:]) + [40, 20 * i, 1])[:3] if len(r) > 1 else (40, 20 * i, 1)
        if len(r) == 3:
            page = 1
        full.append((1, page, i, r[0], Decimal("0.90"), x, y, x + 100, y + 15, 800, 1100))
    return spark.createDataFrame(full, LINE)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Bill To:", "customer_label"), ("Fournisseur", "supplier_label"), ("Échéance", "due_date_label"), ("Invoice Number: INV-7", "invoice_label"), ("Total Due", "total_label"), ("Sous-total", "subtotal_label"),
        ("TVA 19%", "tax_label"), ("Description Qty Price", "table_header"), ("IBAN:", "payment_label"), ("a@b.com", "email"), ("12/05/2024", "date_candidate"), ("1 234,50", "amount"), ("90210", "address_candidate"),
        ("12 Main Street", "address_candidate"), ("Acme Medical LLC", "company_candidate"), ("***", "random_noise"), ("ab", "random_noise"), ("شركة النور للتجارة", "company_candidate"),
    ],
)
def test_node_types(spark, text, kind):
    assert with_predicates(lines(spark, (text,)), "node_type").first()["node_type"] == kind


def test_forbidden_and_company(spark):
    rows = with_predicates(lines(spark, ("Ship To",), ("Acme Trading SARL",), ("Total price",), ("7 Acme LLC",)), "is_forbidden_party", "is_company").orderBy("line_index").collect()
    assert [(r["is_forbidden_party"], r["is_company"]) for r in rows] == [(True, False), (False, True), (True, False), (False, False)]


def test_label_then_value(spark):
    rows = with_predicates(lines(spark, ("Due Date",), ("",), ("05/06/2024",), ("Date facture: 01/02/2024",)))
    got = {r["field"]: r["value"] for r in named(fields, "ext03_following_lines")(lines=rows).collect()}
    assert got == {"due_date": "05/06/2024", "invoice_date": "01/02/2024"}


def test_line_candidates(spark):
    rows = with_predicates(lines(spark, ("Total TTC: 1 234,50 EUR",), ("Subtotal 1000.00",), ("TVA 19% 190.00",), ("PRD-1 Widget 2 10.50 21.00 total",)))
    got = sorted((r["line_index"], r["field"], r["value"], r["score"]) for r in named(fields, "ext02_line_candidates")(lines=rows).collect())
    assert (0, "amount_ttc", "1234.500", 90) in got and (0, "currency", "EUR", 82) in got and (1, "amount_ht", "1000.000", 86) in got and (2, "tax_rate", "19", 78) in got
    assert not [g for g in got if g[0] == 3 and g[1] in ("invoice_number", "currency")]


def test_nearest_date_stays_on_its_page(spark):
    rows = with_predicates(lines(spark, ("Due Date", 40, 100, 1), ("05/06/2024", 160, 100, 2), ("07/08/2024", 160, 130, 1)))
    assert [r["value"] for r in named(fields, "jon08_spatial_dates")(lines=rows).collect()] == ["07/08/2024"]


def test_boxes_of_other_pages_hold_nothing(spark):
    rows = lines(spark, ("a", 40, 100, 1), ("b", 40, 100, 2))
    boxes = spark.createDataFrame([(1, 1, 0, 0, 500, 500)], "doc_id long, page_number int, x1 int, y1 int, x2 int, y2 int")
    assert [r["text"] for r in spatial.outside_blocks(rows, boxes).collect()] == ["b"]


def test_party_winners(spark):
    rows = with_predicates(lines(spark, ("Acme Trading LLC", 40, 40), ("12 Main Street", 40, 64), ("Bill To", 460, 130), ("Beta Medical Inc", 460, 152)))
    got = named(parties, "pty03_winners")(lines=rows).collect()
    assert [(r["supplier"], r["customer"], r["same"]) for r in got] == [("Acme Trading LLC", "Beta Medical Inc", False)]


def test_failure_codes(spark):
    schema = "document_id long, execution_status string, extraction_status string, document_type string, overall_confidence decimal(6,2), supplier_pred string, customer_pred string, number_pred string, date_pred string, currency_pred string, ht_pred decimal(18,3), tva_pred decimal(18,3), ttc_pred decimal(18,3), count_pred int, count_validated int"
    d = Decimal
    rows = spark.createDataFrame(
        [
            (1, "failed", "invalid", "invoice", d("0.9"), None, None, None, None, None, None, None, None, 0, 0),
            (2, "completed", "valid", "invoice", d("0.5"), "Acme Trading LLC", "Beta Inc", "INV-1", "2024-01-01", "EUR", d(100), d(19), d(119), 2, 2),
            (3, "completed", "invalid", "", d("0.85"), "Bill To", "bill to", "2024", None, "EUR", d(100), d(19), d(2020), 0, 0),
        ],
        schema,
    )
    got = {r["document_id"]: r for r in next(s for s in quality.STATEMENTS if s.name == "ftx01_failure_codes")(runs=rows).collect()}
    assert got[1]["codes"] == "EXECUTION_EXCEPTION" and got[1]["categories"] == "execution"
    assert got[2]["codes"] == "" and got[2]["n_codes"] == 0 and got[2]["primary_code"] is None
    codes = got[3]["codes"].split(",")
    assert codes == sorted(codes) and {"DOCUMENT_TYPE_UNKNOWN", "MISSING_INVOICE_DATE", "MISSING_LINE_ITEMS", "PARTY_LABEL_ONLY", "PARTY_SUPPLIER_CUSTOMER_COLLISION", "INVOICE_NUMBER_YEAR_ONLY", "TTC_LOOKS_LIKE_YEAR", "HIGH_CONFIDENCE_INVALID_EXTRACTION", "TOTALS_INCONSISTENT"} <= set(codes)


def test_text_rows(spark):
    rows = with_predicates(lines(spark, ("PRD-7 Widget 2 10.50 21.00",), ("Blue chair 3 4,00 12,00",), ("Words 1 2 9",)))
    got = sorted((r["line_index"], r["code"], r["quantity"], r["price"], r["total"], r["confidence"]) for r in named(layout, "tbl13_text_rows")(lines=rows).collect())
    assert got == [(0, "PRD-7", 2.0, 10.5, 21.0, 72), (1, "", 3.0, 4.0, 12.0, 62)]


def test_duplicates(spark):
    schema = "doc_id long, invoice_number string, supplier_name string, invoice_date string, customer_name string, amount_ttc decimal(18,3)"
    d = Decimal
    rows = spark.createDataFrame([(1, "A", "S", "2024-01-01", "C", d("10.005")), (2, "B", "S", "2024-02-01", "D", d("10.015")), (3, "E", "S", "2024-03-01", "F", d("10.030")), (4, "A", "S", "2024-01-01", "C", None), (5, None, "", None, None, d("10.000"))], schema)
    pairs = {(r["a"], r["b"]): r["n_matched"] for r in validation.duplicate_pairs(rows).collect()}
    assert pairs == {(1, 2): 2, (1, 4): 4}
    assert {r["doc_id"]: r["n_matched"] for r in validation.duplicate_degrees(rows).collect()} == {1: 4, 2: 2, 4: 4}


def test_classifier_keywords(spark):
    docs = spark.createDataFrame([(1, "وصل دفع"), (2, "Quantité livrée et délivrée"), (3, None), (4, "hello")], "doc_id long, text string")
    got = {r["doc_id"]: r["document_type"] for r in classify(docs).collect()}
    assert got == {1: "receipt", 2: "delivery_note", 3: "unknown", 4: "unknown"}


def test_contained_items_of_any_length(spark):
    items = spark.createDataFrame([(1, "one"), (2, "two three"), (3, "a b c"), (4, "p q r s t u"), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "someone has two threes"), (2, "xa b cx"), (3, "zp q r s t uz"), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, contained(items, docs).collect())) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_scalars(spark):
    df = spark.createDataFrame([("ﬁle ①  x\n\n\n\ny", "Ünïcodé ḱ", None)], "a string, b string, c double")
    r = df.select(T.normalize_spacing(F.col("a")).alias("a"), T.strip_accents(F.col("b")).alias("b"), N.confidence(F.col("c")).alias("c"), N.money_or_number(F.lit("lot 7 of goods")).alias("d"), N.benchmark_amount(F.lit("1.234.567")).alias("e")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("file 1 x\n\ny", "Unicode k", None, None, None)


def test_statement_inputs(spark):
    with pytest.raises(TypeError):
        named(reports, "agg14_ratios")(rows=spark.range(1))
    assert matching.canonical_name is not None
