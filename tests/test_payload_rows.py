"""Payloads of any text are read, and the tables for review hold all their rows."""

import duckdb
from decimal import Decimal

from paperloom.functions.predicates import with_predicates
from paperloom.operators import payloads

from .test_statements import LINE, lines, named

ODD = ["Road 7, Suite 4", 'a "quoted" name', "one ] two [ three", "back\\slash \\n", "line\nbreak\tand tab", "{curly}: 'x'", "é النور €", "\x01\x1f", ' ", "x": "y', "plain", "", None]


def test_payloads_of_any_text(spark):
    """Quotes, commas, brackets and escapes in all three shapes."""
    rows = [(d, 1, i, t, c, 10, 20, 30, None if i == 0 else 40, 800, 1100) for d in range(3) for i, t in enumerate(ODD) for c in [Decimal("0.90") if i % 2 else None]]
    table = spark.createDataFrame(rows, LINE)
    statement = named(payloads, "src08_payloads")
    shown = table.withColumn("t", table.text)
    want = sorted(((d, i, t if d == 2 else t or None, None if c is None else float(c)) for d, _, i, t, c, *_ in rows), key=str)
    assert sorted(map(tuple, statement(lines=shown).collect()), key=str) == want
    duck = duckdb.connect()
    duck.execute("create table in_lines (doc_id bigint, page_number int, line_index int, t varchar, confidence decimal(4,2), x1 int, y1 int, x2 int, y2 int, page_width int, page_height int)")
    duck.executemany("insert into in_lines values (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    assert sorted(duck.execute(statement.duck()).fetchall(), key=str) == want


def test_review_tables_hold_all_rows(spark):
    text = with_predicates(lines(spark, ("Subtotal", 560, 600), ("Total Due", 700, 660), ("Acme Trading LLC", 580, 630), ("Blue Chair", 40, 300), ("IBAN: TN59 1000", 40, 700)))
    d = Decimal
    found = [(1, "invoice_number", 1, "a", d("0.720"), None), (1, "invoice_number", 2, "b", d("0.600"), "BL-1"), (1, "due_date", 1, "c", d("0.840"), "2024-12-28"), (1, "tva_amount", 1, "d", d("0.820"), "19.000"), (1, "party_name", 1, "e", d("0.900"), "Acme"), (1, "party_name", 2, "f", d("0.700"), "")]
    candidates = spark.createDataFrame(found, "document_id long, field string, ordinal int, source string, score decimal(6,3), value string")
    goods = [(1, 1, "PRD-1", "chair", d(2), d(10), d(20), None, d("7.00"), d("21.4"), "table review", d("0.62")), (1, 2, "PRD-2", None, None, None, d(30), d(3), d("7.00"), d(33), None, None)]
    items = spark.createDataFrame(goods, "doc_id long, row_index int, reference string, description string, quantity decimal(12,3), unit_price decimal(12,2), line_total_ht decimal(18,3), tax_amount decimal(18,3), tax_rate decimal(6,2), line_total_ttc decimal(18,3), source string, confidence decimal(4,2)")
    got = named(payloads, "prj05_review_tables")(lines=text, items=items, candidates=candidates).collect()
    tables = {}
    for r in got:
        tables.setdefault(r["table_name"], {})[r["row_key"]] = r
    assert len(got) == sum(map(len, tables.values()))
    keys = {t: sorted(rows) for t, rows in tables.items()}
    assert keys.pop("all_extracted_fields") == ["customer_name", "due_date", "invoice_number", "supplier_name", "tva_amount"] == keys.pop("erp_fields")
    assert keys == {
        "line_items": ["line_item_1", "line_item_2"],
        "tax_summary": ["tax 7", "tax_summary_1"],
        "payment_details": ["ocr_1_4", "payment_due_date"],
        "layout_blocks": ["layout_1_payment", "layout_1_totals", "layout_1_unknown"],
        "ocr_blocks": [f"ocr_1_{i}" for i in range(5)],
        "unmapped_text": ["layout_1_unknown", "unmapped_ocr_1_3"],
    }
    fields = tables["erp_fields"]
    assert (fields["invoice_number"]["value"], fields["invoice_number"]["status"], fields["customer_name"]["status"], fields["supplier_name"]["status"]) == ("BL-1", "low_confidence", "missing", "ok")
    assert [tables["line_items"][f"line_item_{i}"]["tax_amount"] for i in (1, 2)] == [1.4, 3.0]
    assert [tables["line_items"][f"line_item_{i}"]["status"] for i in (1, 2)] == ["needs_review", "validated"]
    assert (tables["tax_summary"]["tax 7"]["tax_amount"], tables["tax_summary"]["tax_summary_1"]["tax_amount"]) == (4.4, 19.0)
    assert tables["layout_blocks"]["layout_1_totals"]["value"] == "Subtotal Total Due" and tables["layout_blocks"]["layout_1_totals"]["x2"] == 800
