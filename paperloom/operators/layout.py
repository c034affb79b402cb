"""Geometry of boxes, graph relations, blocks and tables on a page."""

from __future__ import annotations

from ..functions.dialect import any_in, rx
from .statements import Statement

# Fixed values (words that results depend on).
ALIASES = {
    "description": ("description", "designation", "article", "produit", "product", "item", "libelle", "details"),
    "reference": ("reference", "ref", "code produit", "product code", "code", "sku", "article no"),
    "quantity": ("quantity", "quantite", "qty", "qte", "qt", "qte livree"),
    "unit_price": ("unit price", "prix unitaire", "prix unit", "p.u.", "pu", "unit cost", "net price", "rate", "price", "prix"),
    "discount": ("discount", "remise", "rabais", "disc"),
    "tax_rate": ("tva", "vat", "tax", "taxe", "taux"),
    "line_total_ht": ("total ht", "net amount", "net worth", "amount ht", "montant ht"),
    "line_total_ttc": ("total ttc", "gross amount", "gross worth", "gross", "amount due", "line total", "montant", "amount", "worth", "total"),
    "unit": ("unite", "unit", "uom"),
}
FOOTER_TERMS = ("subtotal", "sub total", "sous total", "sous-total", "total ht", "total ttc", "grand total", "total due", "balance due", "summary", "amount paid", "amount due", "sales tax", "vat summary", "tax summary", "tva", "shipping", "delivery fee", "handling", "stamp", "timbre", "discount", "remise", "payment", "iban", "rib", "swift", "bank", "banque", "terms", "conditions")
RELATIONS = {
    "contains": "a.x1 <= b.x1 and a.y1 <= b.y1 and a.x2 >= b.x2 and a.y2 >= b.y2", "overlaps": "a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2", "right_of": "b.x1 >= a.x2", "left_of": "b.x2 <= a.x1",
    "same_line": "abs((a.y1 + a.y2) - (b.y1 + b.y2)) <= 16", "below": "b.y1 >= a.y2", "above": "b.y2 <= a.y1", "same_column": "abs((a.x1 + a.x2) - (b.x1 + b.x2)) <= 80",
    "same_block": "abs(a.y1 - b.y1) <= 60 and abs(a.x1 - b.x1) <= 40", "supplier_label": "a.is_supplier_label", "customer_label": "a.is_customer_label", "total_neighbor": "a.is_total_label and abs(a.y1 - b.y1) <= 40", "date_neighbor": "a.is_due_label and b.is_date",
    "near_totals_block": "b.is_subtotal_label and abs(a.y1 - b.y1) <= 120", "near_table_header": "b.is_table_header and abs(a.y1 - b.y1) <= 120",
}


def alias_hits(c: str) -> str:
    return " + ".join(f"cast(@m({c}, {rx('(^| )(?:' + '|'.join(w.replace('.', '[.]') for w in words) + ')( |$)')}) as int)" for words in ALIASES.values())


FOOTER = f"({any_in('bare', FOOTER_TERMS)} and (n_alpha_words <= 5 or @n(t, {rx('[0-9]')}) >= 2))"
SHAPES = """
with s as (select doc_id, line_index, x1, y1, x2, y2, case line_index % 4 when 0 then concat('[', x1, ', ', y1, ', ', x2, ', ', y2, ']') when 1 then concat('[[', x1, ', ', y1, '], [', x2, ', ', y1, '], [', x2, ', ', y2, '], [', x1, ', ', y2, ']]') when 2 then concat('{"x": ', x1, ', "y": ', y1, ', "w": ', x2 - x1, ', "h": ', y2 - y1, '}') else concat('{"left": ', x1, ', "top": ', y1, ', "right": ', x2, ', "bottom": ', y2, '}') end as shape from $lines),
n as (select *, @all(@rep(shape, ~'"[xywh1-4]+"', ''), ~'-?[0-9]+(?:[.][0-9]+)?') as v from s)"""

STATEMENTS = [
    Statement("geo01_boxes", "Boxes from a rectangle, a polygon, corners or origin and size; only of positive area.",
        SHAPES + """, b as (select doc_id, line_index, @cnt(v, true) as n, case when contains(shape, '"w"') then 1 else 0 end as sized, cast(v[@one()] as double) as a, cast(v[@one() + 1] as double) as b, cast(v[@one() + 2] as double) as c, cast(v[@one() + 3] as double) as d, case when @cnt(v, true) = 8 then cast(v[@one() + 4] as double) end as e, case when @cnt(v, true) = 8 then cast(v[@one() + 5] as double) end as f from n)
select doc_id, line_index, a as x1, b as y1, case when n = 8 then e when sized = 1 then a + c else c end as x2, case when n = 8 then f when sized = 1 then b + d else d end as y2 from b where (case when n = 8 then e when sized = 1 then a + c else c end) > a"""),
    Statement("geo02_clamped", "Boxes within the page; degenerate ones drop out.",
        "with c as (select doc_id, line_index, greatest(0, least(x1 + line_index * 20 - 60, page_width)) as x1, greatest(0, least(y1 - 50, page_height)) as y1, greatest(0, least(x2 + line_index * 20 - 60, page_width)) as x2, greatest(0, least(y2 - 50, page_height)) as y2 from $lines) select * from c where x2 > x1 and y2 > y1"),
    Statement("geo03_mapped", "Boxes from the scale of inference to the page: scale, offset, clamp.",
        "with m as (select doc_id, line_index, x1 * 0.5e0 * 2 + 10 as px1, y1 * 0.5e0 * 2 + 20 as py1, x2 * 0.5e0 * 2 + 10 as px2, y2 * 0.5e0 * 2 + 20 as py2, page_width, page_height from $lines) select doc_id, line_index, greatest(0.0e0, least(px1, page_width)) as x1, greatest(0.0e0, least(py1, page_height)) as y1, greatest(0.0e0, least(px2, page_width)) as x2, greatest(0.0e0, least(py2, page_height)) as y2 from m"),
    Statement("geo04_unions", "The box around the lines of each page.", "select doc_id, page_number, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from $lines group by doc_id, page_number"),
    Statement("geo05_measures", "Centre, distance to the next line, and whether it holds or overlaps it.",
        "with o as (select *, lead(x1) over w as nx1, lead(y1) over w as ny1, lead(x2) over w as nx2, lead(y2) over w as ny2 from $lines window w as (partition by doc_id, page_number order by line_index)) select doc_id, line_index, (x1 + x2) / 2.0e0 as cx, (y1 + y2) / 2.0e0 as cy, round(sqrt(cast((nx1 + nx2 - x1 - x2) * (nx1 + nx2 - x1 - x2) + (ny1 + ny2 - y1 - y2) * (ny1 + ny2 - y1 - y2) as double)) / 2, 4) as distance, x1 <= nx1 and y1 <= ny1 and x2 >= nx2 and y2 >= ny2 as holds, x1 < nx2 and nx1 < x2 and y1 < ny2 and ny1 < y2 as overlaps from o"),
    Statement("geo06_loss_stage", "The first stage of a document at which no box is left.", "with c as (select doc_id, count(*) as n_lines, count(case when confidence >= 0.35 then 1 end) as n_confident, count(case when is_company then 1 end) as n_parties, count(case when is_amount and doc_id % 10 <> 0 then 1 end) as n_amounts from $lines group by doc_id) select doc_id, case when n_lines = 0 then 'recognition' when n_confident = 0 then 'confidence' when n_parties = 0 then 'parties' when n_amounts = 0 then 'amounts' else 'none' end as stage from c"),
    Statement("geo07_word_boxes", "Boxes of words by equal division of the line's box.",
        "with w as (select doc_id, line_index, x1, x2, @words(t) as ws, @cnt(@words(t), true) as n from $lines), k as (select * from (values (0), (1), (2), (3), (4), (5), (6), (7)) as t(i)) select doc_id, line_index, i, ws[@one() + i] as word, round(x1 + (x2 - x1) * i / cast(n as double), 4) as wx1, round(x1 + (x2 - x1) * (i + 1) / cast(n as double), 4) as wx2 from w join k on k.i < w.n"),
    Statement("geo08_density", "Characters an area and alignment of each line.",
        "with m as (select doc_id, max(x2) as w from $lines group by doc_id) select l.doc_id, l.line_index, round(length(text) / cast((x2 - x1) * (y2 - y1) as double), 6) as density, case when x1 < 0.36e0 * w then 'left' when x1 > 0.64e0 * w then 'right' else 'center' end as alignment from $lines l join m on m.doc_id = l.doc_id"),
    Statement("jon01_relations", "Relations of all fifteen kinds between lines of a page at up to 500, with their number and weight (weights are counted in whole units of squared distance).",
        f"""with p as (select a.doc_id, a.line_index as ai, b.line_index as bi, (b.x1 + b.x2 - a.x1 - a.x2) * (b.x1 + b.x2 - a.x1 - a.x2) + (b.y1 + b.y2 - a.y1 - a.y2) * (b.y1 + b.y2 - a.y1 - a.y2) as d4, {", ".join(f"cast({c} as int) as r_{n}" for n, c in RELATIONS.items())}
 from $lines a join $lines b on b.doc_id = a.doc_id and b.page_number = a.page_number and b.line_index <> a.line_index)
select doc_id, count(*) as n_pairs, {", ".join(f"cast(sum(r_{n}) as bigint) as {n}" for n in RELATIONS)}, round(sum(floor(1000 * (1 - least(sqrt(cast(d4 as double)) / 2, 500) / 500))) / 1000, 3) as weight from p where d4 <= 1000000 or r_contains = 1 or r_same_line = 1 group by doc_id"""),
    Statement("win21_block_parents", "The block each line belongs to: the first by priority.", "select doc_id, line_index, case when is_total_label or is_subtotal_label or is_tax_label then 'totals' when y1 < 200 and x1 < 400 then 'supplier' when y1 < 200 then 'customer' when y1 < 560 then 'products' when y1 < 700 then 'totals' else 'footer' end as parent from $lines"),
    Statement("ext24_tree", "The tree of a document: pages, blocks, lines and words counted on each level.", "select doc_id, page_number, case when y1 < 220 then 'header' when y1 < 560 then 'body' else 'end' end as block, count(*) as n_lines, cast(sum(@cnt(@words(t), true)) as bigint) as n_words, min(y1) as top, max(y2) as bottom from $lines group by 1, 2, 3"),
    Statement("prd09_footer", "Lines that end a table: a footer's word in a short line or one with numbers.", f"select doc_id, line_index, {FOOTER} as is_table_footer from $lines"),
    Statement("prd11_row_numbers", "Cells that are a row's number: up to three digits left of the descriptions.", "select doc_id, line_index, col_name, @m(text, ~'^0?[0-9]{1,3}$') and (x1 + x2) / 2.0e0 < 140 as is_row_number from $cells"),
    Statement("prd12_looks_like", "Lines that look like a wrapped fragment, an anchor of a row, a description's start.",
        f"select doc_id, line_index, is_wrapped_fragment, @n(t, {rx(r'[0-9]+[.,][0-9]{2}')}) >= 2 as is_anchor, n_letters >= 4 and not {FOOTER} and not {any_in('bare', ('invoice', 'facture', 'date', 'customer', 'client', 'supplier', 'adresse', 'address', 'iban', 'swift', 'vat', 'tva', 'tax'))} as starts_description from $lines"),
    Statement("prd15_exclusion", "Why a record of the truth is no item: the first reason that holds.",
        f"select doc_id, row_index, case when lower(description) in ('total', 'subtotal', 'grand total') then 'total' when {any_in('lower(description)', ('tva', 'vat', 'sales tax'))} then 'tax' when {any_in('lower(description)', ('quantity', 'unit price'))} then 'header' when {any_in('lower(description)', ('payment', 'iban'))} then 'payment' when contains(lower(description), 'shipping') then 'shipping' when description is null and quantity is null then 'empty' end as reason from $items"),
    Statement("prd18_zone_filters", "Lines that a zone keeps, by its kind.", "select doc_id, line_index, case when y1 < 130 then not is_product_row and not is_amount when y1 < 200 then not is_table_header when y1 < 560 then not is_footer when y1 < 700 then is_amount or is_total_label or is_subtotal_label or is_tax_label else is_payment_label or is_footer or is_contact end as kept from $lines"),
    Statement("tbl01_headers", "Headers of tables: lines with two or more kinds of columns.", f"select doc_id, page_number, line_index, n_kinds from (select doc_id, page_number, line_index, {alias_hits('compact')} as n_kinds from $lines) h where n_kinds >= 2"),
    Statement("tbl02_header_columns", "Columns of a header: the kind of each word and its share of the line.",
        f"with h as (select doc_id, line_index, x1, x2, compact, {alias_hits('compact')} as n_kinds from $lines), k as (select * from (values {', '.join(f'({i}, {chr(39)}{n}{chr(39)}, {chr(39)}{words[0]}{chr(39)})' for i, (n, words) in enumerate(ALIASES.items()))}) as t(i, kind, word)) select h.doc_id, h.line_index, k.kind, round(x1 + (x2 - x1) * (length(split_part(compact, k.word, 1)) / cast(length(compact) as double)), 3) as x_min from h join k on contains(h.compact, k.word) where h.n_kinds >= 2"),
    Statement("tbl03_headerless", "Columns without a header: clusters of centres with two or more cells, the last ones are numbers.",
        "with c as (select doc_id, line_index, (x1 + x2) / 2.0e0 as c from $cells), j as (select doc_id, c, line_index, case when c - lag(c) over (partition by doc_id order by c, line_index) > 38 then 1 else 0 end as jump from c), g as (select doc_id, c, sum(jump) over (partition by doc_id order by c, line_index rows between unbounded preceding and current row) as cluster from j), a as (select doc_id, cluster, count(*) as n, round(sum(c) / count(*), 4) as center from g group by doc_id, cluster having count(*) >= 2), r as (select *, row_number() over (partition by doc_id order by center desc) as from_right from a) select doc_id, center, n, case from_right when 1 then 'total' when 2 then 'unit_price' when 3 then 'quantity' else 'description' end as kind from r"),
    Statement("tbl04_body", "Lines of a table's body: below its header, up to the first footer.",
        f"with s as (select doc_id, page_number, line_index, max(case when is_table_header then 1 else 0 end) over w as started, max(case when {FOOTER} and not is_table_header then 1 else 0 end) over w as stopped, is_table_header from $lines where y1 >= 230 window w as (partition by doc_id, page_number order by y1, x1, line_index rows between unbounded preceding and current row)) select doc_id, line_index from s where started = 1 and stopped = 0 and not is_table_header"),
    Statement("tbl05_cells", "Cells with the column they are in and the reason.",
        "with b as (select doc_id, col_name, cast(sum(x1 + x2) as double) / (2 * count(*)) as center from $cells group by doc_id, col_name), d as (select c.doc_id, c.line_index, b.col_name, abs((c.x1 + c.x2) / 2.0e0 - b.center) as d from $cells c join b on b.doc_id = c.doc_id), r as (select *, row_number() over (partition by doc_id, line_index order by d, col_name) as place from d) select doc_id, line_index, col_name, case when d <= 40 then 'near centre' else 'nearest' end as reason from r where place = 1"),
    Statement("tbl06_logical_rows", "Logical rows: an anchor starts one, lines close below it belong to it.",
        "with o as (select doc_id, page_number, line_index, y1, @n(t, ~'[0-9]+[.,][0-9]{2}') >= 2 as anchor, y1 - lag(y2) over (partition by doc_id, page_number order by y1, x1, line_index) as gap from $lines where y1 between 260 and 560), g as (select *, sum(case when anchor then 1 else 0 end) over (partition by doc_id, page_number order by y1, line_index rows between unbounded preceding and current row) as logical_row from o) select doc_id, line_index, cast(logical_row as bigint) as logical_row, anchor, coalesce(gap <= 26, false) as continues from g"),
    Statement("tbl07_parsed_rows", "Rows with derived totals and prices, warnings, status and confidence.",
        """with d as (select doc_id, row_index, description, quantity, unit_price, coalesce(line_total_ht, cast(quantity * unit_price as decimal(18,3))) as ht, coalesce(line_total_ttc, line_total_ht, cast(quantity * unit_price as decimal(18,3))) as ttc, case when unit_price is null and quantity > 0 then round(cast(line_total_ht as double) / cast(quantity as double), 3) else cast(unit_price as double) end as price from $items),
w as (select *, @codes(case when coalesce(trim(description), '') = '' then 'DESCRIPTION_MISSING' end, case when quantity is null then 'QUANTITY_MISSING' end, case when price is null then 'UNIT_PRICE_MISSING' end, case when ht is null and ttc is null then 'LINE_TOTAL_MISSING' end, case when abs(quantity * unit_price - coalesce(ht, ttc)) > greatest(0.05, abs(coalesce(ht, ttc)) * 0.015) then 'ROW_TOTAL_MISMATCH' end) as warnings from d)
select doc_id, row_index, cast(ht as double) as ht, cast(ttc as double) as ttc, price, warnings, case when contains(warnings, 'MISMATCH') then 'invalid' when warnings <> '' then 'needs_review' else 'validated' end as status, case when contains(warnings, 'MISMATCH') then 38 when warnings <> '' then 62 else 90 end as confidence from w"""),
]
SCORES = """
x as (select doc_id, strategy, ord, header_confirmed, row_index, cast(description is not null as int) + cast(quantity is not null as int) + cast(unit_price is not null as int) + cast(total is not null as int) as parts, case when quantity is not null and unit_price is not null and total is not null then 1 else 0 end as solvable, case when abs(quantity * unit_price - total) <= greatest(0.05, abs(total) * 0.02) then 1 else 0 end as fits, total from $rows),
a as (select doc_id, strategy, ord, header_confirmed, count(*) as n, sum(parts) as parts, sum(solvable) as solvable, sum(fits) as fits, count(total) - count(distinct round(total, 2)) as repeated from x group by doc_id, strategy, ord, header_confirmed),
s as (select *, round(cast(fits as double) / greatest(1, case when solvable > 0 then solvable else n end), 6) as arithmetic, case ord when 1 then case when header_confirmed then 68 else 0 end when 2 then case when n >= 2 then 58 else 50 end when 3 then case when n >= 2 then 50 else 42 end when 4 then 48 when 5 then 36 else 52 end as base from a),
f as (select *, case when base = 0 then 0.0e0 else round(least(1.0e0, greatest(0.0e0, base / 100.0e0 + parts / (4.0e0 * n) * 0.16e0 + arithmetic * 0.16e0 + least(0.12e0, n * 0.02e0) - least(0.18e0, greatest(0, repeated) * 0.04e0))), 4) end as score from s)"""
STATEMENTS += [
    Statement("tbl08_strategies", "Rows by strategy: how many each reconstructs, how many are complete.", "select doc_id, strategy, count(*) as n_rows, count(case when description is not null and quantity is not null and unit_price is not null and total is not null then 1 end) as n_complete from $rows group by doc_id, strategy"),
    Statement("tbl09_strategy_scores", "Score of each strategy: base, completeness, arithmetic, rows, less repeated totals.", "with " + SCORES.strip() + " select doc_id, strategy, n, arithmetic, score from f"),
    Statement("tbl10_selected_strategy", "The strategy of a document: columns unless another is better by 0.18 and its arithmetic holds; unresolved where a confirmed header has no rows.",
        "with " + SCORES.strip() + """, c as (select doc_id, max(case when ord = 1 then score end) as columnar, max(case when header_confirmed then 1 else 0 end) as confirmed from f group by doc_id),
k as (select f.*, c.columnar, c.confirmed, case when c.columnar > 0 then case when ord = 1 or (score >= c.columnar + 0.18e0 and arithmetic >= 0.8e0) then 1 else 0 end when c.confirmed = 1 then 0 when ord = 2 then cast(score >= 0.6e0 as int) when ord = 6 then cast(score >= 0.72e0 and n >= 2 as int) when ord = 3 then cast(score >= 0.6e0 as int) when ord = 4 then cast(score >= 0.7e0 as int) when ord = 5 then cast(score >= 0.62e0 as int) else 0 end as allowed from f join c on c.doc_id = f.doc_id),
r as (select *, row_number() over (partition by doc_id order by allowed desc, score desc, arithmetic desc, ord) as place from k)
select doc_id, case when allowed = 1 then strategy else 'UNRESOLVED' end as selected, case when allowed = 1 then score else 0.0e0 end as score from r where place = 1"""),
    Statement("tbl11_profiles", "Strategies that a profile accepts.", "select distinct doc_id, strategy, strategy in ('COLUMNAR_TABLE', 'HEADERLESS_COLUMNAR') as p3_stable, true as p3_1_adaptive from $rows"),
    Statement("tbl12_cascade", "Rows of the first source that has any: reconstruction, then anchors, then coordinates, then text.", "with p as (select doc_id, strategy, row_index, case strategy when 'COLUMNAR_TABLE' then 1 when 'HEADERLESS_COLUMNAR' then 2 when 'NUMERIC_ANCHORED_ROWS' then 3 when 'KEY_VALUE_RECORDS' then 4 else 5 end as place from $rows), b as (select doc_id, min(place) as place from p group by doc_id) select p.doc_id, p.strategy, p.row_index from p join b on b.doc_id = p.doc_id and b.place = p.place"),
    Statement("tbl13_text_rows", "Rows parsed from text: a product code and numbers, else a description and three numbers that agree within 35 percent.",
        f"""with n as (select doc_id, line_index, t, regexp_extract(t, {rx('([A-Z]{2,}[A-Z0-9]*-[A-Z0-9]+)')}, 1) as code, @all(t, {rx(r'[0-9]+(?:[.,][0-9]+)?')}) as v from $lines), k as (select *, @cnt(v, true) as n from n),
r as (select doc_id, line_index, code, t, n, try_cast(replace(@at(v, n - 3), ',', '.') as double) as quantity, try_cast(replace(@at(v, n - 2), ',', '.') as double) as price, try_cast(replace(@at(v, n - 1), ',', '.') as double) as total from k where n >= 3)
select doc_id, line_index, code, quantity, price, total, case when code <> '' then 72 else 62 end as confidence from r where total > 0 and @m(t, {rx(r'^[\p{L}A-Z]')}) and abs(quantity * price - total) <= 0.35e0 * total"""),
    Statement("tbl15_split_rows", "Rows merged by mistake, split at repeated row numbers.",
        "with m as (select doc_id, concat('1 ', min(t), ' 2 ', max(t)) as merged from $lines where y1 between 290 and 345 group by doc_id), k as (select * from (values (1), (2)) as t(i)) select m.doc_id, k.i as row_number_found, case k.i when 1 then split_part(split_part(merged, '1 ', 2), ' 2 ', 1) else split_part(merged, ' 2 ', 2) end as description from m cross join k"),
    Statement("tbl14_numeric_alignment", "Legacy tables: cells that align with numbers of two or more rows.", "with a as (select doc_id, @even(x2 / 10.0e0) as x, count(*) as n from $cells where @m(text, ~'^[0-9.]+$') group by 1, 2) select doc_id, x, n, 42 as confidence from a where n >= 2"),
    Statement("tbl16_accounting", "How many cells of a document went where.", "select doc_id, count(*) as n_cells, count(case when text = '' then 1 end) as n_empty, count(case when @m(text, ~'^[0-9.]+$') then 1 end) as n_numeric, count(distinct col_name) as n_columns from $cells group by doc_id"),
    Statement("win10_row_groups", "Rows grouped by anchors, with the lines before the first as prefix.", "with g as (select doc_id, line_index, sum(case when col_name = 'row' then 1 else 0 end) over (partition by doc_id order by y1, x1, line_index rows between unbounded preceding and current row) as row_group from $cells) select doc_id, cast(row_group as bigint) as row_group, count(*) as n from g group by doc_id, row_group"),
    Statement("jon17_nearest_description", "The description nearest to a row that lacks one, within two rows.",
        "with m as (select doc_id, row_index from $items where description is null), c as (select m.doc_id, m.row_index, i.row_index as from_row, abs(i.row_index - m.row_index) as d, i.description from m join $items i on i.doc_id = m.doc_id and i.description is not null and abs(i.row_index - m.row_index) <= 2) select doc_id, row_index, from_row, description from (select *, row_number() over (partition by doc_id, row_index order by d, from_row) as place from c) r where place = 1"),
    Statement("jon19_recovered_totals", "Totals recovered from combinations that agree within 0.3 percent; a missing tax follows from the others.",
        """with c as (select document_id, 'ht' as f, ht_pred as v, cast(0.60 as decimal(6,3)) as s from $runs union all select document_id, 'ht', cast(ttc_true - tva_pred as decimal(18,3)), cast(0.55 as decimal(6,3)) from $runs union all select document_id, 'tva', case when document_id % 8 = 0 then null else tva_pred end, cast(0.60 as decimal(6,3)) from $runs union all select document_id, 'ttc', ttc_pred, cast(0.60 as decimal(6,3)) from $runs union all select document_id, 'ttc', ttc_true, cast(0.50 as decimal(6,3)) from $runs),
j as (select h.document_id, h.v as ht, coalesce(t.v, cast(c.v - h.v as decimal(18,3))) as tva, c.v as ttc, h.s + case when t.v is null then 0.25 else t.s end + c.s as s from c h join c t on t.document_id = h.document_id and t.f = 'tva' join c c on c.document_id = h.document_id and c.f = 'ttc' where h.f = 'ht' and h.v is not null and c.v is not null),
m as (select *, abs(ht + tva - ttc) as mismatch from j where tva >= 0), k as (select *, row_number() over (partition by document_id order by s - mismatch desc, ht, tva, ttc) as place from m where mismatch <= greatest(0.05, abs(ttc) * 0.003))
select document_id, cast(ht as double) as ht, cast(tva as double) as tva, cast(ttc as double) as ttc from k where place = 1"""),
]
