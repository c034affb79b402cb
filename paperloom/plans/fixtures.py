"""Document views derived from the relational tables.

Each is one SQL text that Spark and DuckDB both run, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "line_items": """
select l.l_orderkey as doc_id,
 cast(row_number() over (partition by l.l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus) as int) as row_index,
 l_suppkey as supp_id, concat('PRD-', l_partkey) as reference,
 case when (l_orderkey*7+l_linenumber) % 29 = 0 then null else p_name end as description,
 case when (l_orderkey+l_linenumber) % 23 = 0 then null else cast(l_quantity as decimal(12,3)) end as quantity,
 cast(p_retailprice as decimal(12,2)) as unit_price,
 cast(cast(l_quantity as decimal(12,3))*cast(p_retailprice as decimal(12,2)) + case when (l_orderkey+l_partkey) % 19 = 0 then 250.00 else 0.00 end as decimal(18,3)) as line_total_ht,
 cast(cast(l_tax as decimal(4,2))*100 as decimal(6,2)) as tax_rate
from {lineitem} l join {part} p on p.p_partkey = l.l_partkey""",
    "line_items_tax": "select *, cast(line_total_ht*cast(tax_rate*0.01 as decimal(8,4)) as decimal(18,3)) as tax_amount from {line_items}",
    "invoices": """
select t.doc_id,
 case when t.doc_id % 17 = 0 then null else concat('INV-', t.doc_id) end as invoice_number,
 s.s_name as supplier_name, case when t.doc_id % 13 = 0 then null else c.c_name end as customer_name,
 cast(o.o_orderdate as date) as invoice_date,
 case when t.doc_id % 31 = 0 then null when c.c_nationkey % 3 = 0 then 'EUR' when c.c_nationkey % 3 = 1 then 'USD' else 'TND' end as currency,
 t.ht as amount_ht, t.tva as tva_amount,
 cast(case t.doc_id % 7 when 0 then t.ht + t.tva + 500.00 when 1 then t.ht + t.tva + 0.03 when 2 then null else t.ht + t.tva end as decimal(18,3)) as amount_ttc
from (select doc_id, min(supp_id) as supp_id, cast(sum(line_total_ht) as decimal(18,3)) as ht, cast(sum(tax_amount) as decimal(18,3)) as tva from {line_items_tax} group by doc_id) t
join {orders} o on o.o_orderkey = t.doc_id join {customer} c on c.c_custkey = o.o_custkey join {supplier} s on s.s_suppkey = t.supp_id""",
    "attempts": """
select user_id as document_id, event_id as log_seq, concat('ds', user_id % 5) as dataset_name,
 case event_type when 'error' then 'failed' when 'signup' then 'timeout' else 'completed' end as execution_status,
 case when event_type in ('error','signup') then 'unavailable' when event_id % 11 = 0 then 'valid' when event_id % 3 = 0 then 'needs_review' else 'invalid' end as extraction_status,
 cast(value as decimal(12,2)) as duration_seconds, (event_type = 'view') as disk_cache_hit, ts as started_at
from {events}""",
    "ocr_lines": """
select li.doc_id, 1 as page_number, cast(li.row_index*5 + k.ord as int) as line_index, k.col as col_name,
 case k.ord when 0 then concat('', li.row_index) when 1 then coalesce(li.description,'') when 2 then coalesce(concat('', cast(li.quantity as int)),'') when 3 then concat('', li.unit_price) else concat('', li.line_total_ht) end as text,
 cast(0.90 as decimal(4,2)) as confidence,
 k.x1 + (li.doc_id % 3) as x1, 100 + 24*li.row_index + (k.ord % 2)*3 as y1, k.x2 + (li.doc_id % 3) as x2, 118 + 24*li.row_index + (k.ord % 2)*3 as y2
from {line_items} li cross join (select * from (values (0,'row',20,35),(1,'description',60,220),(2,'quantity',370,400),(3,'unit_price',455,530),(4,'total',720,790)) as t(ord,col,x1,x2)) k""",
    "invoice_text": """
select doc_id, concat('Facture N° ', coalesce(invoice_number,''), chr(10), 'Date facture: ', invoice_date, chr(10), 'Fournisseur: ', supplier_name, chr(10), 'Client: ', coalesce(customer_name,''), chr(10),
 'Total HT: ', amount_ht, chr(10), 'TVA 19%: ', tva_amount, chr(10), 'Total TTC: ', coalesce(concat('',amount_ttc),''), ' ', coalesce(currency,'')) as text from {invoices}""",
    "page_lines": """
select i.doc_id, k.page as page_number, k.ord as line_index,
 replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(case i.doc_id % 3 when 0 then k.en when 1 then k.fr else k.alt end,
  '{{sup}}', i.supplier_name), '{{cus}}', coalesce(i.customer_name, 'Walk In')), '{{no}}', coalesce(i.invoice_number, '')), '{{date}}', concat('', i.invoice_date)),
  '{{dmy}}', concat(lpad(concat('', day(i.invoice_date)), 2, '0'), '/', lpad(concat('', month(i.invoice_date)), 2, '0'), '/', year(i.invoice_date))),
  '{{due}}', concat(lpad(concat('', 1 + i.doc_id % 28), 2, '0'), '/12/', year(i.invoice_date))),
  '{{ht}}', concat('', i.amount_ht)), '{{tva}}', concat('', i.tva_amount)), '{{ttc}}', coalesce(concat('', i.amount_ttc), '')), '{{cur}}', coalesce(i.currency, '')) as raw_text,
 cast(k.conf as decimal(4,2)) as confidence, k.x1 + (i.doc_id % 4) as x1, k.y1 as y1, k.x2 + (i.doc_id % 4) as x2, k.y2 as y2, 800 as page_width, 1100 as page_height
from {invoices} i cross join (select * from (values
 (0,1,40,40,300,60,0.97,'{{sup}} LLC','{{sup}} SARL','{{sup}} Trading Group'),
 (1,1,40,64,260,80,0.93,'12 Main Street','12 rue de Paris','Road 7, Suite 4'),
 (2,1,40,84,260,100,0.91,'contact@shop{{n}}.com','Tél: +216 71 234 567','Phone: 555-123-4567'),
 (3,1,460,40,700,60,0.95,'Invoice Number: {{no}}','Facture N° {{no}}','Invoice Number'),
 (4,1,460,64,700,80,0.94,'Invoice Date: {{date}}','Date facture: {{dmy}}','{{no}}'),
 (5,1,460,84,560,100,0.92,'Due Date','Echéance','Due Date: {{due}}'),
 (6,1,580,84,700,100,0.92,'{{due}}','{{due}}','Date: {{dmy}}'),
 (7,1,460,130,600,148,0.90,'Bill To','Client','Customer'),
 (8,1,460,152,700,170,0.94,'{{cus}} Inc','{{cus}} Trading','{{cus}} Medical'),
 (9,1,460,174,700,190,0.88,'Tax ID: 99{{n}}00A','MF: 123{{n}}/A','VAT number: FR{{n}}77'),
 (10,1,40,240,790,258,0.96,'Description Qty Unit Price Total','Désignation Qté Prix Unitaire Montant','Item Description | Quantity | Price | Amount'),
 (11,1,40,270,790,288,0.89,'PRD-{{n}} Widget 2 10.50 21.00','PRD-{{n}} Câble 3 4,00 12,00','Box of screws 4 2.50 10.00'),
 (12,1,60,300,220,318,0.86,'Blue Chair','Chaise Bleue','Service plan'),
 (13,1,60,320,220,338,0.84,'of wood and steel','en bois et acier','per month'),
 (14,1,560,600,660,618,0.93,'Subtotal','Total HT','Sub total: {{ht}}'),
 (15,1,700,600,790,618,0.95,'{{ht}}','{{ht}}','Sales Tax'),
 (16,1,560,630,660,648,0.93,'Sales Tax','TVA 19%','{{tva}}'),
 (17,1,700,630,790,648,0.95,'{{tva}}','{{tva}}','Shipping 0.00'),
 (18,1,560,660,660,678,0.94,'Total Due','Total TTC','Amount Due: {{ttc}} {{cur}}'),
 (19,1,700,660,790,678,0.95,'{{ttc}} {{cur}}','{{ttc}} {{cur}}','Grand total {{ttc}}'),
 (20,1,40,700,300,718,0.90,'Payment details','IBAN: TN59 1000 6035 1835 9847','Bank: First Bank'),
 (21,1,40,730,120,748,0.80,'K1A 0B1','75001','90210'),
 (22,1,40,760,300,778,0.85,'Thank you for your business','Merci de votre confiance','Terms and conditions apply'),
 (23,1,40,790,60,800,0.30,'***','--','ab'),
 (24,1,40,130,300,148,0.91,'PO Number: PO-{{n}}','Bon de commande: BC-{{n}}','Order number ON{{n}}'),
 (25,1,40,160,300,178,0.83,'شركة النور للتجارة','شركة الامل','النور'),
 (26,2,40,40,120,58,0.92,'Page 2','Page 2','Page 2'),
 (27,2,40,70,300,88,0.95,'{{sup}} LLC','{{sup}} SARL','{{sup}} Trading Group'),
 (28,2,460,70,700,88,0.20,'lorem dolor amet','lorem dolor amet','lorem'),
 (29,2,560,600,700,618,0.93,'Net worth','Résumé TVA','Gross worth {{ttc}}')
) as t(ord,page,x1,y1,x2,y2,conf,en,fr,alt)) k""",
    "lines": "select doc_id, page_number, line_index, replace(raw_text, '{{n}}', concat('', doc_id)) as text, confidence, x1, y1, x2, y2, page_width, page_height from {page_lines}",
    "runs": """
select i.doc_id as document_id, concat('ds', i.doc_id % 5) as dataset_name, concat('batch', i.doc_id % 3, '/doc-', i.doc_id, '.png') as relative_path,
 case when i.doc_id % 41 = 0 then 'failed' when i.doc_id % 37 = 0 then 'timeout' when i.doc_id % 43 = 0 then 'interrupted' else 'completed' end as execution_status,
 case i.doc_id % 4 when 0 then 'valid' when 1 then 'needs_review' else 'invalid' end as extraction_status, case when i.doc_id % 3 = 0 then 'ready' else 'blocked' end as erp_status,
 case when i.doc_id % 47 = 0 then '' when i.doc_id % 29 = 0 then 'receipt' else 'invoice' end as document_type,
 case when i.doc_id % 53 = 0 then null else cast((i.doc_id * 7919 % 101) * 0.01 as decimal(6,2)) end as overall_confidence,
 case i.doc_id % 11 when 0 then null when 1 then 'Bill To' when 2 then 'Unit Price' when 3 then '75001' when 4 then concat(i.supplier_name, ' LLC') when 5 then 'The goods were sent. They came: late' else i.supplier_name end as supplier_pred, i.supplier_name as supplier_true,
 case when i.doc_id % 13 = 1 then i.supplier_name when i.doc_id % 13 = 2 then concat('  ', upper(i.customer_name), ' Inc.') else i.customer_name end as customer_pred, i.customer_name as customer_true,
 case i.doc_id % 9 when 0 then '2024' when 1 then '12/05/2024' when 2 then cast(i.amount_ttc as string) else i.invoice_number end as number_pred, i.invoice_number as number_true,
 case when i.doc_id % 19 = 0 then null else cast(i.invoice_date as string) end as date_pred, cast(i.invoice_date as string) as date_true, i.currency as currency_pred, coalesce(i.currency, 'EUR') as currency_true,
 i.amount_ht as ht_pred, case when i.doc_id % 23 = 0 then cast(i.amount_ht * 2 as decimal(18,3)) else i.tva_amount end as tva_pred, case when i.doc_id % 59 = 0 then cast(2020 as decimal(18,3)) when i.doc_id % 61 = 0 then cast(0.5 as decimal(18,3)) when i.doc_id % 67 = 0 then cast(-3 as decimal(18,3)) else i.amount_ttc end as ttc_pred, cast(i.amount_ht + i.tva_amount as decimal(18,3)) as ttc_true,
 cast(case when i.doc_id % 17 = 0 then 0 else i.doc_id % 6 end as int) as count_pred, cast(i.doc_id % 7 as int) as count_true, cast(case when i.doc_id % 17 = 0 then 0 else (i.doc_id % 6) - (i.doc_id % 2) * (case when i.doc_id % 6 = 0 then 0 else 1 end) end as int) as count_validated,
 i.doc_id % 10 <> 0 as header_found, i.doc_id % 5 <> 0 as header_confirmed, i.doc_id % 4 <> 0 as region_found, i.doc_id % 8 <> 0 as body_found, i.doc_id % 9 <> 0 as rows_found,
 case i.doc_id % 12 when 0 then 'unsupported' when 1 then 'adapter_failed' when 2 then 'explicit_zero' else 'supported' end as truth_status, i.doc_id % 6 < 2 as changed_by_adapter,
 cast((i.doc_id * 31 % 6007) * 0.01 as decimal(8,2)) as seconds, i.doc_id % 3 = 1 as fresh_ocr, i.doc_id % 6 = 2 as disk_hit, i.doc_id % 2 = 0 as hybrid_invoked, case i.doc_id % 4 when 1 then 'parsed' when 3 then 'malformed' else 'skipped' end as parser_status
from {invoices} i""",
    "field_rows": """
select r.document_id, r.dataset_name, k.field, k.kind,
 case k.field when 'supplier_name' then supplier_pred when 'customer_name' then customer_pred when 'invoice_number' then number_pred when 'invoice_date' then date_pred when 'currency' then currency_pred when 'amount_ttc' then cast(ttc_pred as string) else cast(count_pred as string) end as predicted,
 case k.field when 'supplier_name' then supplier_true when 'customer_name' then customer_true when 'invoice_number' then number_true when 'invoice_date' then date_true when 'currency' then currency_true when 'amount_ttc' then cast(ttc_true as string) else cast(count_true as string) end as truth
from {runs} r cross join (select * from (values ('supplier_name','party'),('customer_name','party'),('invoice_number','id'),('invoice_date','date'),('currency','currency'),('amount_ttc','amount'),('line_items','count')) as t(field,kind)) k""",
    "proposals": """
select document_id, field, predicted as deterministic, case document_id % 5 when 0 then truth when 1 then predicted when 2 then substr(truth, 1, 4) when 3 then 'invented' end as proposed, case when document_id % 31 = 0 then null else truth end as truth, document_id % 2 = 0 as accepted,
 concat('v', document_id % 4 + 1) as prompt_version, case field when 'supplier_name' then 'missing_supplier_name' when 'customer_name' then 'missing_customer_name' when 'amount_ttc' then 'financial_inconsistency' when 'line_items' then 'line_items_need_review' when 'invoice_date' then 'missing_invoice_date' when 'currency' then 'low_overall_confidence' else 'validation_needs_review' end as trigger_reason
from {field_rows}""",
    "items_full": """
select doc_id, row_index, reference, case when (doc_id + row_index) % 31 = 0 then 'total' when (doc_id + row_index) % 37 = 0 then 'ab' else description end as description, quantity, case when (doc_id + row_index) % 41 = 0 then null else unit_price end as unit_price, line_total_ht, tax_amount, case when (doc_id + row_index) % 43 = 0 then cast(8.8 as decimal(6,2)) else tax_rate end as tax_rate,
 cast(line_total_ht + tax_amount + case when doc_id % 11 = 0 then 40 else 0 end as decimal(18,3)) as line_total_ttc, case doc_id % 4 when 0 then 'flexible numeric row' when 1 then 'table review' else 'table' end as source, case when doc_id % 3 = 0 then cast(0.62 as decimal(4,2)) else cast(0.92 as decimal(4,2)) end as confidence
from {line_items_tax}""",
    "candidates": """
select r.document_id, k.field, k.ordinal, k.source, cast(k.score as decimal(6,3)) as score,
 case k.field when 'invoice_number' then case k.ordinal when 1 then number_pred when 2 then concat('BL-', document_id) else number_true end
  when 'invoice_date' then case k.ordinal when 1 then date_true when 2 then 'soon' else concat(substr(date_true, 9, 2), '/', substr(date_true, 6, 2), '/', substr(date_true, 1, 4)) end
  when 'due_date' then case when document_id % 3 = 0 then date_true else concat(substr(date_true, 1, 4), '-12-28') end
  when 'amount_ttc' then case k.ordinal when 1 then cast(ttc_pred as string) when 2 then cast(ht_pred as string) else cast(ttc_true as string) end
  when 'amount_ht' then cast(ht_pred as string) when 'tva_amount' then cast(tva_pred as string) when 'tax_rate' then case when document_id % 9 = 0 then '190' else '19' end
  when 'currency' then case k.ordinal when 1 then currency_pred else currency_true end else case k.ordinal when 1 then supplier_pred else customer_pred end end as value, document_type
from {runs} r cross join (select * from (values ('invoice_number',1,'regex',0.72),('invoice_number',2,'number near document label',0.86),('invoice_number',3,'document graph',0.70),('invoice_date',1,'date near date label',0.78),('invoice_date',2,'table row',0.80),('invoice_date',3,'spatial date label due',0.87),
 ('due_date',1,'due-date label followed by value',0.84),('amount_ttc',1,'semantic totals cluster ttc',0.70),('amount_ttc',2,'amount near ht/subtotal label',0.86),('amount_ttc',3,'sum of reconstructed line totals',0.74),('amount_ht',1,'totals block',0.86),('tva_amount',1,'amount near tax label',0.82),
 ('tax_rate',1,'tax rate percent',0.78),('currency',1,'currency near totals',0.82),('currency',2,'currency token',0.58),('party_name',1,'supplier header',0.9),('party_name',2,'customer block',0.7)) as t(field,ordinal,source,score)) k""",
    "strategy_rows": """
select i.doc_id, k.strategy, i.row_index, case when k.ord = 3 and i.row_index = 1 then null else i.description end as description, case when k.ord >= 2 and (i.doc_id + i.row_index) % 3 = 0 then null else i.quantity end as quantity, i.unit_price,
 case when k.ord = 1 and i.doc_id % 4 = 0 then cast(i.line_total_ht + 100 as decimal(18,3)) else i.line_total_ht end as total, i.doc_id % 5 <> 0 as header_confirmed, k.ord as ord
from {items_full} i cross join (select * from (values ('COLUMNAR_TABLE',1),('KEY_VALUE_RECORDS',2),('NUMERIC_ANCHORED_ROWS',3),('HEADERLESS_COLUMNAR',4),('SINGLE_ITEM_SUMMARY',5),('REPEATED_VERTICAL_BLOCKS',6)) as t(strategy,ord)) k
where (i.doc_id + k.ord) % 7 <> 0 and (k.ord <> 5 or i.row_index = 1)""",
}
NEEDS = {"line_items": (), "line_items_tax": ("line_items",), "invoices": ("line_items_tax",), "attempts": (), "ocr_lines": ("line_items",), "invoice_text": ("invoices",), "page_lines": ("invoices",), "lines": ("page_lines",), "runs": ("invoices",), "field_rows": ("runs",), "proposals": ("field_rows",), "items_full": ("line_items_tax",), "candidates": ("runs",), "strategy_rows": ("items_full",)}


_KEPT: dict[tuple[str, str], DataFrame] = {}


def keep(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Persist views that many queries of one session share."""
    for name in names:
        _KEPT[sf_dir, name] = load(spark, sf_dir, name).persist()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    if (sf_dir, name) in _KEPT:
        return _KEPT[sf_dir, name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t: load(spark, sf_dir, t) for t in (*TABLES, *VIEWS) if "{" + t + "}" in sql}
    if name == "page_lines":
        # An invoice moves to its place once, its thirty lines don't.
        used["invoices"] = used["invoices"].repartition("doc_id")
    return spark.sql(sql, **used)


def with_views(*names: str) -> str:
    """The WITH clause that defines views for an oracle, without the last comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ", ".join(f"{n} as ({VIEWS[n].format(**{t: t for t in (*TABLES, *VIEWS)})})" for n in order)
