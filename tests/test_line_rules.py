"""Rules over lines are evaluated once and only where needed, with the same results."""

import pytest

from paperloom.functions import predicates
from paperloom.functions.dialect import column, spark
from paperloom.operators import fields, layout, parties, payloads

ODD = ["", " ", ":", "Total:", "total\n", "Client :", "client\n", "Bill To: Shop", "Unité Prix Qté Total", "Price price price", "id | description", "facture n° 7", "K1A 0B1", "75001", "***", "a@b.co", "+216 71 234 567", "شركة النور للتجارة", "Échéance", "12/05/2024", "$ 1.234,50", "ACME & CO LTD", "Total Due 12.50 EUR", "sous-total #", None]
ODD += [f"{x}{m}" for x in ("payment", "iban", "supplier", "due date", "from") for m in ("", ":", " #1", "\n", "s", " now")]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, 1, k, t, c, 10, 20 * k, 200, 20 * k + 15, 800, 1100) for i, c in enumerate((0.2, 0.9, None)) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, line_index int, text string, confidence double, x1 int, y1 int, x2 int, y2 int, page_width int, page_height int")


def test_as_by_stages(lines):
    staged = lines
    for stage in predicates.STAGES:
        staged = staged.select("*", *[column(rule).alias(name) for name, rule in stage.items()])
    whole = predicates.with_predicates(lines)
    assert sorted(whole.columns) == sorted(staged.columns)
    got, want = (sorted(map(str, df.select(*sorted(staged.columns)).collect())) for df in (whole, staged))
    assert got == want


STATEMENTS = {s.name: s for m in (fields, layout, parties, payloads) for s in m.STATEMENTS}


@pytest.mark.parametrize("name", ["jon04_numbers_near", "jon06_best_amount", "jon16_nearest_numeric", "ext05_layout_candidates", "ext07_spatial_dates", "ext09_summary_table", "ext12_text_parties", "jon01_relations", "jon10_safe_header", "win07_label_values", "prj04_field_boxes", "pty01_scores", "pty02_ranked", "pty03_winners", "tbl01_headers", "src08_payloads"])
def test_text_folded_once(lines, name):
    """No filter repeats the folding of a text; long methods are split."""
    statement = STATEMENTS[name]
    session = lines.sparkSession
    session.conf.unset("spark.sql.codegen.hugeMethodLimit")
    plan = statement(lines=predicates.with_predicates(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert all(x.count("translate(") <= 1 for x in plan.splitlines())
    assert session.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_amount_reads_its_token_once():
    assert spark(fields.amount("a_token")).count("a_token") == 1


@pytest.mark.parametrize("text,want", [("1.234,50", "1234.500"), ("-1,234.50", "-1234.500"), ("1.234.567", "1234.567"), ("1,234,567", "1234.567"), ("--7,5", "-7.500"), ("$ 12", "12.000"), ("", None), ("n/a", None), (None, None), ("1.2.3,4", "123.400")])
def test_amounts(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(column(fields.amount("x")).cast("string")).first()[0]
    assert got == want
