"""Queries over invoices and line items, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from .fixtures import load, with_views
from .registry import query

AS_OF = "1998-01-01"

ROW_SQL = """
, checked as (
 select *, abs(quantity*unit_price - line_total_ht) as delta,
  case when description is null or trim(description) = '' then 1 else 0 end + case when quantity is null then 1 else 0 end as n_missing
 from line_items_tax),
flagged as (
 select *, case when coalesce(quantity <= 0, false) or coalesce(line_total_ht < 0, false) or coalesce(delta > greatest(0.05, abs(line_total_ht)*0.01), false) then 1 else 0 end as bad,
  case when coalesce(delta > 0.01, false) then 1 else 0 end as off from checked),
row_checks as (
 select *, case when bad = 1 then 'invalid' when n_missing > 0 or off = 1 then 'needs_review' else 'validated' end as row_status,
  case when bad = 1 then 0.35 when n_missing > 0 or off = 1 then 0.62 else 0.92 end as row_confidence from flagged),
row_sums as (
 select doc_id, count(*) as total, count(*) filter (row_status = 'validated') as validated, count(*) filter (row_status = 'needs_review') as needs_review,
  count(*) filter (row_status = 'invalid') as invalid, round(cast(sum(cast(row_confidence as decimal(4,2))) as double)/count(*), 3) as validation_score from row_checks group by doc_id),
line_sums as (
 select doc_id, cast(sum(line_total_ht) as decimal(18,3)) as ht, cast(sum(tax_amount) as decimal(18,3)) as tva, count(distinct tax_rate) as n_rates from line_items_tax group by doc_id),
fin as (
 select i.*, s.ht as line_ht, s.n_rates,
  coalesce(abs(amount_ht+tva_amount-amount_ttc) > greatest(0.05, abs(amount_ttc)*0.005), false) as bad_total,
  amount_ttc is null as no_ttc, n_rates > 1 as mixed,
  coalesce(abs(s.ht-amount_ht) > greatest(0.05, abs(amount_ht)*0.02), false) as bad_lines
 from invoices i left join line_sums s using (doc_id)),
fin2 as (
 select *, case when bad_total then 0.35 when no_ttc or mixed or bad_lines then 0.68 else 0.95 end as financial_score,
  not bad_total and not no_ttc and not bad_lines as consistent from fin)
"""


def _rows(spark, sf_dir):
    return V.check_rows(load(spark, sf_dir, "line_items_tax"))


def _financial(spark, sf_dir):
    return V.check_totals(load(spark, sf_dir, "invoices"), V.line_totals(load(spark, sf_dir, "line_items_tax")))


@query(with_views("line_items_tax", "invoices") + ROW_SQL + "select doc_id, row_index, row_status, cast(row_confidence as double) as row_confidence, cast(delta as double) as delta, n_missing from row_checks")
def val02_row_check(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("doc_id", "row_index", "row_status", F.col("row_confidence").cast("double").alias("row_confidence"), F.col("delta").cast("double").alias("delta"), F.size("missing").alias("n_missing"))


@query(with_views("line_items_tax", "invoices") + ROW_SQL + "select * from row_sums")
def agg03_row_summary(spark, sf_dir):
    return V.summarize_rows(_rows(spark, sf_dir))


@query(with_views("line_items_tax", "invoices") + ROW_SQL + "select doc_id, cast(ht as double) as ht, cast(tva as double) as tva, cast(ht+tva as double) as ttc, n_rates from line_sums")
def agg04_line_totals(spark, sf_dir):
    rows = V.line_totals(load(spark, sf_dir, "line_items_tax"))
    return rows.select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("ht", "tva", "ttc")], "n_rates")


@query(with_views("line_items_tax", "invoices") + ROW_SQL + "select doc_id, cast(financial_score as double) as financial_score, consistent, bad_total as has_errors from fin2")
def fin01_financial(spark, sf_dir):
    return _financial(spark, sf_dir).select("doc_id", F.col("financial_score").cast("double").alias("financial_score"), "consistent", (F.size("financial_errors") > 0).alias("has_errors"))


VAL01_SQL = f"""
, v as (
 select *, coalesce(amount_ttc <= 0, false) or coalesce(abs(amount_ht+tva_amount-amount_ttc) > greatest(0.05, abs(amount_ttc)*0.001), false) as bad,
  case when invoice_number is null then 1 else 0 end + case when invoice_date is null then 1 else 0 end + case when invoice_date > date '{AS_OF}' then 1 else 0 end
  + case when amount_ttc is null then 2 else 0 end + case when currency is null then 1 else 0 end
  + case when abs(amount_ht+tva_amount-amount_ttc) > 0.01 and abs(amount_ht+tva_amount-amount_ttc) <= greatest(0.05, abs(amount_ttc)*0.001) then 1 else 0 end as n_warnings
 from invoices)
"""


@query(with_views("invoices") + VAL01_SQL + "select doc_id, case when bad then 'invalid' when n_warnings > 0 then 'needs_review' else 'valid' end as status, n_warnings from v")
def val01_invoice(spark, sf_dir):
    return V.check_invoices(load(spark, sf_dir, "invoices"), AS_OF).select("doc_id", "status", F.size("warnings").alias("n_warnings"))


CONF_SQL = """
, parts as (
 select f.*, r.invalid, r.needs_review, r.validation_score,
  case when v.bad then 'invalid' when v.n_warnings > 0 then 'needs_review' else 'valid' end as status,
  cast(cast(cast(0.80 + f.doc_id % 20 * 0.01 as decimal(9,3))*0.18 + cast(0.70 + f.doc_id % 25 * 0.01 as decimal(9,3))*0.12 as decimal(12,5)) + cast(cast(r.validation_score as decimal(9,3))*0.14 as decimal(12,5))
   + cast(cast(1 - 0.16 * (case when f.invoice_number is null then 1 else 0 end + case when f.customer_name is null then 1 else 0 end + case when f.currency is null then 1 else 0 end + case when f.amount_ttc is null then 1 else 0 end) as decimal(9,3))*0.20 as decimal(12,5))
   + cast(cast(f.financial_score as decimal(9,3))*0.16 as decimal(12,5)) + cast(cast(r.validation_score as decimal(9,3))*0.12 as decimal(12,5)) + cast((case when f.doc_id % 4 <> 0 then cast(0.50 + f.doc_id % 50 * 0.01 as decimal(9,3)) else 1 end)*0.08 as decimal(12,5)) as decimal(12,5)) as raw
 from fin2 f join row_sums r using (doc_id) join v using (doc_id)),
conf as (select *, cast(raw as decimal(9,3)) as confidence,
  invoice_number is null or customer_name is null or currency is null or amount_ttc is null as missing from parts)
"""


def _confident(spark, sf_dir):
    """Invoices checked once, with one aggregation of their checked rows; what
    recognition, layout and export say is planted by document."""
    rows = V.check_totals(load(spark, sf_dir, "invoices"), V.line_statistics(_rows(spark, sf_dir)))
    rows = V.check_invoices(rows, AS_OF)
    planted = lambda base, step: (F.lit(base) + F.col("doc_id") % step * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(9,3)")
    missing = F.size(V.missing_required())
    score = V.overall_confidence(
        ocr=planted(F.lit("0.80").cast("decimal(4,2)"), 20),
        layout=planted(F.lit("0.70").cast("decimal(4,2)"), 25),
        table=F.col("validation_score"),
        fields=F.lit("1.000").cast("decimal(9,3)") - missing * F.lit("0.160").cast("decimal(9,3)"),
        financial=F.col("financial_score"),
        validation=F.col("validation_score"),
        erp=F.when(F.col("doc_id") % 4 != 0, planted(F.lit("0.50").cast("decimal(4,2)"), 50)),
    )
    return rows.withColumn("confidence", score)


@query(with_views("line_items_tax", "invoices") + ROW_SQL + VAL01_SQL + CONF_SQL + "select doc_id, cast(confidence as double) as confidence from conf")
def cnf01_confidence(spark, sf_dir):
    return _confident(spark, sf_dir).select("doc_id", F.col("confidence").cast("double").alias("confidence"))


@query(
    with_views("line_items_tax", "invoices") + ROW_SQL + VAL01_SQL + CONF_SQL
    + """select doc_id, cast(least(confidence, case status when 'invalid' then 0.59 when 'needs_review' then 0.79 else 9 end, case when missing then 0.69 else 9 end,
    case when not consistent then 0.84 else 9 end, case when financial_score < 0.5 or cast(validation_score as decimal(9,3)) < 0.5 then 0.74 else 9 end) as double) as capped from conf"""
)
def cnf02_caps(spark, sf_dir):
    rows = _confident(spark, sf_dir)
    out = V.capped(F.col("confidence"), F.col("status"), F.size(V.missing_required()) > 0, F.col("consistent"), F.col("financial_score"), F.col("validation_score").cast("decimal(9,3)"))
    return rows.select("doc_id", out.cast("double").alias("capped"))


ERP_SQL = CONF_SQL + """
, erp as (
 select *, least(1.0, greatest(0.0, cast(confidence as double)*0.45e0 + cast(financial_score as double)*0.30e0 + validation_score*0.25e0)) as erp_score from conf),
ready as (
 select *, case when bad_total or invalid > 0 then 'Rejected' when missing or needs_review > 0 or erp_score < 0.78e0 or not consistent then 'Needs Review' else 'ERP Ready' end as erp_status from erp)
"""


@query(with_views("line_items_tax", "invoices") + ROW_SQL + VAL01_SQL + ERP_SQL + "select erp_status, count(*) as n_invoices, count(*) filter (missing) as n_missing, cast(sum(amount_ht) as double) as amount_ht from ready group by erp_status")
def erp01_readiness(spark, sf_dir):
    rows = V.readiness(_confident(spark, sf_dir))
    return rows.groupBy("erp_status").agg(F.count("*").alias("n_invoices"), F.count_if(F.size("missing_fields") > 0).alias("n_missing"), F.sum("amount_ht").cast("double").alias("amount_ht"))


@query(
    with_views("invoices") + VAL01_SQL
    + """select supplier_name as vendor_name, concat('TX', doc_id % 97) as vendor_tax_id, cast(invoice_date + interval 30 day as date)::varchar as due_date, '{"ref":"' || coalesce(invoice_number, '') || '"}' as source_payload, invoice_number as invoice_ref, cast(invoice_date as varchar) as invoice_date, cast(amount_ht as double) as amount_excl_tax, cast(tva_amount as double) as tax_amount,
    cast(amount_ttc as double) as amount_incl_tax, currency as currency_code, case when bad then 'invalid' when n_warnings > 0 then 'needs_review' else 'valid' end as validation_status from v"""
)
def prj02_flat_export(spark, sf_dir):
    rows = V.check_invoices(load(spark, sf_dir, "invoices"), AS_OF)
    rows = rows.withColumns({"vendor_tax_id": F.concat(F.lit("TX"), F.col("doc_id") % 97), "due_date": F.date_add("invoice_date", 30).cast("string"), "source_payload": F.to_json(F.struct(F.coalesce("invoice_number", F.lit("")).alias("ref")))})
    return rows.select("vendor_tax_id", "due_date", "source_payload", F.col("supplier_name").alias("vendor_name"), F.col("invoice_number").alias("invoice_ref"), F.col("invoice_date").cast("string").alias("invoice_date"), F.col("amount_ht").cast("double").alias("amount_excl_tax"), F.col("tva_amount").cast("double").alias("tax_amount"), F.col("amount_ttc").cast("double").alias("amount_incl_tax"), F.col("currency").alias("currency_code"), F.col("status").alias("validation_status"))


@query(
    with_views("invoices")
    + VAL01_SQL
    + """select v.doc_id, supplier_name as supplier, invoice_number as number, cast(amount_ttc as double) as ttc, case when bad then 'invalid' when n_warnings > 0 then 'needs_review' else 'valid' end as status, n.n as n_items
    from v join (select doc_id, cast(count(*) as integer) as n from line_items group by doc_id) n on n.doc_id = v.doc_id"""
)
def prj01_nested_document(spark, sf_dir):
    """The nested export document of each invoice as JSON, and what stands in it."""
    items = load(spark, sf_dir, "line_items").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "reference", "description", "quantity", "unit_price", "line_total_ht"))).alias("line_items"))
    rows = V.check_invoices(load(spark, sf_dir, "invoices"), AS_OF).join(items, "doc_id", "left")
    document = F.struct(
        F.struct(F.col("supplier_name").alias("name")).alias("supplier"),
        F.struct(F.col("customer_name").alias("name")).alias("customer"),
        F.struct(F.col("invoice_number").alias("number"), F.col("invoice_date").alias("date"), "currency").alias("document"),
        F.struct(F.col("amount_ht").alias("ht"), F.col("tva_amount").alias("tva"), F.col("amount_ttc").alias("ttc")).alias("amounts"),
        F.struct((F.col("status") != "valid").alias("needs_human_review")).alias("quality"),
        F.struct("status", "errors", "warnings").alias("validation"),
        "line_items",
    )
    rows = rows.select("doc_id", F.to_json(document).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    return rows.select("doc_id", at("$.supplier.name").alias("supplier"), at("$.document.number").alias("number"), at("$.amounts.ttc").cast("double").alias("ttc"), at("$.validation.status").alias("status"), F.json_array_length(at("$.line_items")).alias("n_items"))


@query(
    with_views("invoices")
    + """, p as (select a.doc_id as a, b.doc_id as b,
     case when a.invoice_number = b.invoice_number then 1 else 0 end + case when a.supplier_name = b.supplier_name then 1 else 0 end + case when a.invoice_date = b.invoice_date then 1 else 0 end
     + case when a.customer_name = b.customer_name then 1 else 0 end + case when abs(a.amount_ttc-b.amount_ttc) <= 0.01 then 1 else 0 end as n
     from invoices a join invoices b on a.doc_id < b.doc_id)
    select a, b, n as n_matched, least(1.0e0, (45 + n*11)/100.0e0) as confidence from p where n >= 2"""
)
def jon20_duplicates(spark, sf_dir):
    rows = load(spark, sf_dir, "invoices")
    return V.duplicate_pairs(rows)


@query(
    with_views("invoices")
    + """, p as (select a.doc_id as a, b.doc_id as b,
     case when a.invoice_number = b.invoice_number then 1 else 0 end + case when a.supplier_name = b.supplier_name then 1 else 0 end + case when a.invoice_date = b.invoice_date then 1 else 0 end
     + case when a.customer_name = b.customer_name then 1 else 0 end + case when abs(a.amount_ttc-b.amount_ttc) <= 0.01 then 1 else 0 end as n
     from invoices a join invoices b on a.doc_id <> b.doc_id)
    select i.doc_id, max(n) is not null as possible_duplicate, coalesce(max(case when n is not null then least(1.0e0, (45 + n*11)/100.0e0) end), 0.0e0) as duplicate_confidence
    from invoices i left join p on p.a = i.doc_id and p.n >= 2 group by i.doc_id"""
)
def dup01_decision(spark, sf_dir):
    rows = load(spark, sf_dir, "invoices")
    n = F.col("n_matched")
    best = V.duplicate_degrees(rows).select("doc_id", F.least(F.lit(1.0), (45 + n * 11) / 100).alias("c"))
    return rows.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.col("c").isNotNull().alias("possible_duplicate"), F.coalesce("c", F.lit(0.0)).alias("duplicate_confidence"))


TRIPLE_SQL = """
, c as (select doc_id, 'amount_ht' as field, amount_ht as value, 0.86 as score from invoices union all select doc_id, 'amount_ht', amount_ttc, 0.74 from invoices where amount_ttc is not null
 union all select doc_id, 'tva_amount', tva_amount, 0.82 from invoices union all select doc_id, 'amount_ttc', amount_ttc, 0.90 from invoices where amount_ttc is not null union all select doc_id, 'amount_ttc', cast(amount_ht + tva_amount as decimal(18,3)), 0.66 from invoices)
"""


@query(
    with_views("invoices") + TRIPLE_SQL
    + """, t as (select h.doc_id, h.value as ht, t.value as tva, c.value as ttc, cast(h.score + t.score + c.score - abs(h.value + t.value - c.value) as decimal(18,6)) as fit
      from c h join c t on t.doc_id = h.doc_id and t.field = 'tva_amount' join c c on c.doc_id = h.doc_id and c.field = 'amount_ttc'
      where h.field = 'amount_ht' and abs(h.value + t.value - c.value) <= greatest(0.05, abs(c.value)*0.002))
    select doc_id, cast(ht as double) as amount_ht, cast(tva as double) as tva_amount, cast(ttc as double) as amount_ttc, cast(fit as double) as fit
    from (select *, row_number() over (partition by doc_id order by fit desc, ht, tva, ttc) as pos from t) where pos = 1"""
)
def jon18_triples(spark, sf_dir):
    rows = load(spark, sf_dir, "invoices")
    one = lambda f, v, s: rows.where(v.isNotNull()).select("doc_id", F.lit(f).alias("field"), v.cast("decimal(18,3)").alias("value"), F.lit(s).cast("decimal(4,2)").alias("score"))
    found = one("amount_ht", F.col("amount_ht"), "0.86").union(one("amount_ht", F.col("amount_ttc"), "0.74")).union(one("tva_amount", F.col("tva_amount"), "0.82"))
    found = found.union(one("amount_ttc", F.col("amount_ttc"), "0.90")).union(one("amount_ttc", F.col("amount_ht") + F.col("tva_amount"), "0.66"))
    return V.consistent_triples(found).select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("amount_ht", "tva_amount", "amount_ttc", "fit")])


@query(with_views("line_items") + "select doc_id, row_index, cast(tax_rate as double) as tax_rate, least(abs(tax_rate-0),abs(tax_rate-7),abs(tax_rate-10),abs(tax_rate-13),abs(tax_rate-19),abs(tax_rate-20)) > 0.5 as suspicious from line_items")
def val05_suspicious_rate(spark, sf_dir):
    return load(spark, sf_dir, "line_items").select("doc_id", "row_index", F.col("tax_rate").cast("double").alias("tax_rate"), V.suspicious_rate(F.col("tax_rate")).alias("suspicious"))


@query(with_views("line_items") + "select doc_id, reference, cast(row_index as integer) as row_index from (select *, row_number() over (partition by doc_id, reference, quantity, unit_price, line_total_ht order by row_index) as pos from line_items) where pos = 1")
def set07_dedupe_items(spark, sf_dir):
    rows = load(spark, sf_dir, "line_items")
    first = rows.groupBy("doc_id", "reference", "quantity", "unit_price", "line_total_ht").agg(F.min("row_index").alias("row_index"))
    return first.select("doc_id", "reference", "row_index")


@query(with_views("invoices") + "select currency, doc_id % 10 as bucket, cast(sum(case when amount_ttc is null then 20 else 40 end) as bigint) as votes from invoices where currency is not null group by currency, doc_id % 10 qualify row_number() over (partition by doc_id % 10 order by sum(case when amount_ttc is null then 20 else 40 end) desc, currency) = 1")
def agg06_currency_vote(spark, sf_dir):
    from pyspark.sql import Window

    votes = load(spark, sf_dir, "invoices").where("currency is not null").groupBy("currency", (F.col("doc_id") % 10).alias("bucket")).agg(F.sum(F.when(F.col("amount_ttc").isNull(), 20).otherwise(40)).alias("votes"))
    best = Window.partitionBy("bucket").orderBy(F.desc("votes"), "currency")
    return votes.withColumn("at", F.row_number().over(best)).where("at = 1").drop("at")
