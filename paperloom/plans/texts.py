"""Queries over texts, recognized lines and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import extraction as X
from ..operators import spatial as S
from .fixtures import load, with_views
from .registry import query

L = with_views("ocr_lines")
NORM = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
PLAIN = "trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents")


@query(f"select doc_id, {NORM} as norm from documents")
def str07_norm(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.words_only(F.col("text")).alias("norm"))


@query("select doc_id, strip_accents(text) as plain from documents")
def str02_accents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_accents(F.col("text")).alias("plain"))


@query("select doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') as ident, substr(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), 1, 120) as compact from documents")
def str09_identifier(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.identifier(F.col("text")).alias("ident"), T.compact(F.col("text"), 120).alias("compact"))


@query("select page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) as name, regexp_replace(upper(url), '[^A-Z0-9]', '', 'g') as bare, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') as key from pages")
def str14_names(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"), T.iban(F.col("url")).alias("bare"), T.label_key(F.col("url")).alias("key"))


@query("select c_custkey, regexp_replace(lower(c_name) || ' trading co ltd inc', '((^| )(bv|corp|corporation|eurl|gmbh|inc|limited|llc|llp|ltd|nv|plc|sa|sarl|sas|sasu|snc|spa|suarl))+$', '') as bare, regexp_replace('ship to ' || lower(c_name), '^(supplier|customer|bill to|ship to|vendor|seller|client|buyer|from)( |$)', '') as name from customer")
def str11_legal_form(spark, sf_dir):
    rows = load(spark, sf_dir, "customer")
    low = F.lower("c_name")
    return rows.select("c_custkey", T.without_legal_form(F.concat(low, F.lit(" trading co ltd inc"))).alias("bare"), T.without_role_label(F.concat(F.lit("ship to "), low)).alias("name"))


@query(f"select doc_id, cast(len(list_distinct(list_filter(string_split({PLAIN}, ' '), lambda x: x <> ''))) as integer) as n_tokens from documents")
def arr01_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(F.array_distinct(T.tokens(T.plain_words(F.col("text"))))).alias("n_tokens"))


@query("select doc_id, substr(sha256(concat(source, '|', lang, '|', n_chars, '|', doc_id)), 1, 16) as key from documents")
def hsh01_document_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.document_key(F.col("source"), F.col("lang"), F.col("n_chars"), F.col("doc_id")).alias("key"))


@query(f"select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by {NORM}")
def win18_first_by_text(spark, sf_dir):
    rows = _docs(spark, sf_dir).where("text is not null")
    return rows.groupBy(F.sha2(T.words_only(F.col("text")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


SIM = """
with p as (select a.p_partkey, trim(regexp_replace(lower(a.p_name), '[^a-z0-9]+', ' ', 'g')) as x, trim(regexp_replace(lower(a.p_type), '[^a-z0-9]+', ' ', 'g')) as y from part a),
t as (select p_partkey, x, y, list_distinct(list_filter(string_split(x, ' '), lambda v: v <> '')) as tx, list_distinct(list_filter(string_split(y, ' '), lambda v: v <> '')) as ty from p)
select p_partkey, case when x = '' or y = '' then 0e0 when x = y then 1e0 when contains(x, y) or contains(y, x) then 0.9e0 else cast(len(list_intersect(tx, ty)) as double) / len(list_distinct(list_concat(tx, ty))) end as similarity from t
"""


@query(SIM)
def sim03_similarity(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query(with_views("invoice_text") + "select i.doc_id, cast(amount_ttc as double) as dot, cast(amount_ttc as double) as comma, cast(amount_ht as double) as grouped from invoices i")
def num01_amounts(spark, sf_dir):
    """Amounts in three notations parse to the value they came from."""
    rows = load(spark, sf_dir, "invoices")
    ttc, ht = F.col("amount_ttc").cast("string"), F.col("amount_ht")
    return rows.select("doc_id", N.amount(F.concat(ttc, F.lit(" TND"))).cast("double").alias("dot"), N.amount(F.replace(ttc, F.lit("."), F.lit(","))).cast("double").alias("comma"), N.amount(F.format_number(ht.cast("decimal(18,3)"), 3)).cast("double").alias("grouped"))


@query("select o_orderkey, cast(o_orderdate as date)::varchar as d1, cast(o_orderdate as date)::varchar as d2, case when day(o_orderdate) <= 12 and day(o_orderdate) <> month(o_orderdate) then 2 else 1 end as n_readings from orders")
def dat01_dates(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    dmy = F.date_format("d", "dd/MM/yyyy")
    return rows.select("o_orderkey", N.day_first(F.date_format("d", "yyyy.MM.dd")).cast("string").alias("d1"), N.day_first(dmy).cast("string").alias("d2"), F.size(N.possible_dates(dmy)).alias("n_readings"))


@query("select n_nationkey, case n_nationkey % 4 when 0 then 'EUR' when 1 then 'TND' when 2 then 'USD' else upper(substr(n_name, 1, 3)) end as currency from nation")
def num09_currency(spark, sf_dir):
    raw = F.when(F.col("n_nationkey") % 4 == 0, "€").when(F.col("n_nationkey") % 4 == 1, "dt").when(F.col("n_nationkey") % 4 == 2, "US$").otherwise(F.col("n_name"))
    return load(spark, sf_dir, "nation").select("n_nationkey", N.currency(raw).alias("currency"))


CLASSES = " union all ".join(f"select {i} as rank, '{t}' as type, lower(strip_accents('{k.replace(chr(39), chr(39) * 2)}')) as k" for i, (t, ks) in enumerate(X.KEYWORDS.items()) for k in ks)


@query(
    with_views("invoice_text")
    + f", kw as ({CLASSES}), src as (select doc_id, lower(strip_accents(text)) as t from invoice_text union all select -1 - item_id, lower(text) || case when item_id % 3 = 0 then ' delivery note shipped refund' when item_id % 3 = 1 then ' po number' else ' وصل دفع رقم الفاتورة' end from benchmark), "
    "h as (select doc_id, type, rank, count(*) as n from src join kw on contains(t, k) group by doc_id, type, rank), b as (select * from (select *, row_number() over (partition by doc_id order by n desc, rank) as pos from h) where pos = 1) "
    "select src.doc_id, coalesce(type, 'unknown') as document_type, cast(coalesce(n, 0) as integer) as n_matched, cast(case when n is null then 0 else least(98, 45 + n*14) end as integer) as confidence_percent from src left join b using (doc_id)"
)
def agg07_classify(spark, sf_dir):
    extra = load(spark, sf_dir, "benchmark")
    tail = F.when(F.col("item_id") % 3 == 0, " delivery note shipped refund").when(F.col("item_id") % 3 == 1, " po number").otherwise(" وصل دفع رقم الفاتورة")
    docs = load(spark, sf_dir, "invoice_text").unionByName(extra.select((-1 - F.col("item_id")).alias("doc_id"), F.concat("text", tail).alias("text")))
    return X.classify(docs)


@query(
    with_views("invoices")
    + """select doc_id, field, value from (select doc_id, unnest(['invoice_number','invoice_date','supplier_name','customer_name','amount_ht','tva_amount','amount_ttc']) as field,
    unnest([invoice_number, cast(invoice_date as varchar), supplier_name, customer_name, cast(amount_ht as varchar), cast(tva_amount as varchar), cast(amount_ttc as varchar)]) as value from invoices) where value is not null"""
)
def ext02_label_lines(spark, sf_dir):
    return X.best_candidates(X.candidates(load(spark, sf_dir, "invoice_text"))).select("doc_id", "field", "value")


@query(with_views("invoices") + "select doc_id, label, cast(amount as double) as amount from (select doc_id, unnest(['total ht','tva','total ttc']) as label, unnest([amount_ht, tva_amount, amount_ttc]) as amount from invoices) where amount is not null")
def agg05_labelled_amounts(spark, sf_dir):
    return X.labelled_amounts(load(spark, sf_dir, "invoice_text")).select("doc_id", "label", F.col("amount").cast("double").alias("amount"))


@query(L + "select doc_id, line_index, row_number() over (partition by doc_id order by page_number, y1, x1, line_index) - 1 as reading_order from ocr_lines")
def win01_reading_order(spark, sf_dir):
    return S.reading_order(load(spark, sf_dir, "ocr_lines")).select("doc_id", "line_index", "reading_order")


@query(L + "select doc_id, cast(round_even(y1/18.0e0, 0) as integer) as bucket, string_agg(text, ' ' order by x1, line_index, text) as text, cast(count(*) as integer) as n_cells from ocr_lines group by 1, 2")
def win03_buckets(spark, sf_dir):
    return S.row_buckets(load(spark, sf_dir, "ocr_lines")).select("doc_id", "bucket", "text", "n_cells")


@query(L + ", m as (select *, line_index//5 as row_index from ocr_lines), g as (select *, case when x1 - lag(x2) over w >= 100 then 1 else 0 end as s from m window w as (partition by doc_id, page_number, row_index order by x1, line_index)) select doc_id, line_index, cast(sum(s) over (partition by doc_id, page_number, row_index order by x1, line_index) as bigint) as segment from g")
def win04_gap_segments(spark, sf_dir):
    rows = load(spark, sf_dir, "ocr_lines").withColumn("row_index", F.floor(F.col("line_index") / 5))
    return S.gap_segments(rows).select("doc_id", "line_index", F.col("segment").cast("long").alias("segment"))


COLS = L + ", cols as (select doc_id, page_number, col_name, cast(sum(x1+x2) as double)/(2*count(*)) as center from ocr_lines group by 1,2,3), bounds as (select *, (lag(center) over w + center)/2 as x_min, (lead(center) over w + center)/2 as x_max from cols window w as (partition by doc_id, page_number order by center)) "


@query(COLS + "select doc_id, col_name, center, x_min, x_max from bounds")
def win06_column_bounds(spark, sf_dir):
    return S.column_bounds(load(spark, sf_dir, "ocr_lines")).select("doc_id", "col_name", "center", "x_min", "x_max")


@query(COLS + "select l.doc_id, l.line_index, b.col_name, true as inside from ocr_lines l join bounds b on l.doc_id = b.doc_id and (l.x1+l.x2)/2.0e0 >= coalesce(b.x_min, -1e9) and (l.x1+l.x2)/2.0e0 < coalesce(b.x_max, 1e9)")
def jon11_assign_columns(spark, sf_dir):
    rows = load(spark, sf_dir, "ocr_lines")
    return S.assign_columns(rows, S.column_bounds(rows)).select("doc_id", "line_index", "col_name", "inside")


E_SQL = """
, p as (select a.doc_id, a.line_index as a, b.line_index as b, (b.x1+b.x2-a.x1-a.x2)/2.0e0 as dx, (b.y1+b.y2-a.y1-a.y2)/2.0e0 as dy, a.x1 ax1, a.x2 ax2, a.y1 ay1, a.y2 ay2, b.x1 bx1, b.x2 bx2, b.y1 by1, b.y2 by2
 from ocr_lines a join ocr_lines b on a.doc_id = b.doc_id and a.page_number = b.page_number and a.line_index <> b.line_index),
e as (select doc_id, a, b, dx*dx+dy*dy as d2, unnest([case when ax1 < bx2 and bx1 < ax2 and ay1 < by2 and by1 < ay2 then 'overlaps' end, case when bx1 >= ax2 then 'right_of' end, case when bx2 <= ax1 then 'left_of' end,
 case when by1 >= ay2 then 'below' end, case when by2 <= ay1 then 'above' end, case when abs(dy) <= 8 then 'same_line' end, case when abs(dx) <= 20 then 'same_column' end]) as relation from p where dx*dx+dy*dy <= 3600)
select relation, count(*) as n_edges, sum(d2) as d2 from e where relation is not null group by relation
"""


@query(L + E_SQL)
def jon01_edges(spark, sf_dir):
    return S.edges(load(spark, sf_dir, "ocr_lines")).groupBy("relation").agg(F.count("*").alias("n_edges"), F.sum("d2").alias("d2"))


NEAR = """
, p as (select l.doc_id, l.line_index as label_index, v.line_index as value_index, v.text as value, abs(v.x1-l.x1) + 0.12e0*abs(v.y1-l.y1) as cost from ocr_lines l join ocr_lines v on l.doc_id = v.doc_id and l.page_number = v.page_number
 where l.col_name = 'row' and v.col_name = 'total' and v.y1 >= l.y1 - 6)
select doc_id, label_index, value_index, value from (select *, row_number() over (partition by doc_id, label_index order by cost, value_index) as pos from p) where pos = 1
"""


@query(L + NEAR)
def jon07_nearest_amount(spark, sf_dir):
    rows = load(spark, sf_dir, "ocr_lines")
    cost = F.abs(F.col("v_x1") - F.col("l_x1")) + 0.12 * F.abs(F.col("v_y1") - F.col("l_y1"))
    return S.nearest(rows.where("col_name = 'row'"), rows.where("col_name = 'total'"), F.col("v_y1") >= F.col("l_y1") - 6, cost).select("doc_id", "label_index", "value_index", "value")


@query(
    L
    + """, e as (select doc_id, page_number, y1 - 8 as k, 0 as kind, line_index as anchor, cast(null as integer) as line from ocr_lines where col_name = 'row' union all select doc_id, page_number, y1, 1, cast(null as integer), line_index from ocr_lines),
    w as (select *, last_value(anchor ignore nulls) over (partition by doc_id, page_number order by k, kind, anchor rows between unbounded preceding and current row) as a from e) select doc_id, a as anchor, line as line_index from w where kind = 1 and a is not null"""
)
def jon15_bands(spark, sf_dir):
    rows = load(spark, sf_dir, "ocr_lines")
    return S.bands(rows.where("col_name = 'row'"), rows).select("doc_id", "anchor", "line_index")


PAGES = with_views("lines")
BLOCKS = PAGES + ", z as (select *, case when x1 < 300 then 'left' else 'right' end as zone from lines) select doc_id, page_number, zone, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as n_lines, cast(sum(confidence) as double)/count(*) as confidence, string_agg(text, ' ' order by y1, x1, line_index) as text from z group by doc_id, page_number, zone"


@query(BLOCKS)
def agg02_blocks(spark, sf_dir):
    return S.blocks(load(spark, sf_dir, "lines"), {"left": F.col("x1") < 300, "right": F.col("x1") >= 300})


@query(
    PAGES
    + """select doc_id, line_index from lines l where not exists (select 1 from (select doc_id, page_number, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 from lines where confidence >= 0.94 group by doc_id, page_number) b
    where b.doc_id = l.doc_id and b.page_number = l.page_number and l.x1 >= b.x1 and l.x2 <= b.x2 and l.y1 >= b.y1 and l.y2 <= b.y2)"""
)
def jon12_outside_blocks(spark, sf_dir):
    rows = load(spark, sf_dir, "lines")
    boxes = rows.where("confidence >= 0.94").groupBy("doc_id", "page_number").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return S.outside_blocks(rows, boxes).select("doc_id", "line_index")


@query("select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)")
def jon29_containment(spark, sf_dir):
    return X.contained(load(spark, sf_dir, "benchmark"), _docs(spark, sf_dir))
