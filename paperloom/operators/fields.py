"""Fields from recognized lines: token grammars, labels and what follows them,
neighbours on the page, re-ranking and selection of candidates. Joins carry
(doc_id, page_number); windows run within a document. Scores are decimals."""

from __future__ import annotations

from ..functions.dialect import any_in, rx
from .statements import Statement

# Fixed values (patterns that results depend on).
AMOUNT = r"[+-]?(?:[0-9][0-9 .]*[,.][0-9]{2,3}|[0-9]{1,3}(?:[ .][0-9]{3})+|[0-9]+)"
MONTH = r"(?:jan(?:uary|vier)?|feb(?:ruary)?|fevr(?:ier)?|mar(?:ch|s)?|apr(?:il)?|avril|may|mai|june?|juin|july?|juillet|aug(?:ust)?|aout|sep(?:t(?:ember)?)?|septembre|oct(?:ober|obre)?|nov(?:ember|embre)?|dec(?:ember)?|decembre)\.?"
DATE = rf"(?:[0-9]{{1,2}}[/.\-][0-9]{{1,2}}[/.\-][0-9]{{2,4}}|[0-9]{{4}}[/.\-][0-9]{{1,2}}[/.\-][0-9]{{1,2}}|{MONTH}\s+[0-9]{{1,2}},?\s+[0-9]{{2,4}}|[0-9]{{1,2}}\s+{MONTH},?\s+[0-9]{{2,4}})"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"
PHONE = r"(?:\+?[0-9]{1,3}[\s.-]?)?(?:[0-9][\s.-]?){6,}"
PRODUCT_CODE = r"\b[A-Z]{2,}[A-Z0-9]*-[A-Z0-9]+"
NUMBER = r"(?i)(?:invoice|facture)\s*(?:number|no\.?|n°|#|ref)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9_/.\-]{2,})"
TAX_ID = r"(?i)(?:matricule fiscal|tax id|vat (?:number|no)|identifiant fiscal|MF|ICE|RC)\s*[:#-]?\s*([A-Z0-9/.\-]{5,})"
ORDER = r"(?i)(?:purchase order|po (?:number|no)|bon de commande|order (?:number|no))\s*[:#-]?\s*([A-Z0-9_/.\-]{3,})"
CODES = ("TND", "EUR", "USD", "GBP", "MAD", "DZD", "CAD", "CHF", "AED")
HT_LABELS = ("sous-total", "total ht", "subtotal", "sub total", "hors taxe", "htva", "net worth")
TVA_LABELS = ("tva", "vat", "sales tax", "tax amount")
TTC_LABELS = ("total ttc", "montant ttc", "grand total", "amount due", "balance due", "total due", "net a payer", "invoice total", "gross worth")


def amount(c: str) -> str:
    """The amount that a token stands for, in either notation."""
    return f"@amount({c})"


def first(c: str, pattern: str) -> str:
    return f"nullif(regexp_extract({c}, {rx('(' + pattern + ')')}, 1), '')"


def group(c: str, pattern: str) -> str:
    return f"nullif(regexp_extract({c}, {rx(pattern)}, 1), '')"


CURRENCY = "case " + " ".join(f"when @m(upper(text), {rx(chr(92) + 'b' + c + chr(92) + 'b')}) then '{c}'" for c in CODES) + " when contains(text, '€') then 'EUR' when contains(text, '$') then 'USD' end"
AMOUNTS = f"@all(text, {rx(AMOUNT)})"
LAST_AMOUNT = amount(f"nullif(regexp_extract(@rep(text, {rx(r'[0-9.,]+ *%')}, ''), {rx('.*?(' + AMOUNT + ')[^0-9]*$')}, 1), '')")
IS_TABLE_ROW = f"(@n(text, {rx(AMOUNT)}) >= 2 and (@m(text, {rx(PRODUCT_CODE)}) or {any_in('bare', ('description', 'designation', 'qty', 'quantity', 'price', 'prix', 'total'))}))"
ORDERED = "row_number() over (partition by doc_id order by page_number, y1, x1, line_index)"
DUE = f"(is_due_context or {any_in('bare', ('due date', 'echeance', 'date limite', 'payment due'))})"
DATED = f"(not is_order_context and not {DUE} and ({any_in('bare', ('invoice date', 'date facture', 'issue date', 'date of issue', 'date emission'))} or @starts(bare, 'date')))"

#: The logical block that a line belongs to.
KIND = "case when is_total_label or is_subtotal_label or is_tax_label then 'totals' when is_payment_label then 'payment' when is_invoice_label or is_due_label then 'metadata' when is_customer_label then 'customer' when is_supplier_label then 'supplier' when is_table_header or is_product_row then 'products' when is_footer then 'footer' end"

LABEL_RULES = f"""
select *, {first('bare', DATE)} as d, {LAST_AMOUNT} as a, {IS_TABLE_ROW} as row_like, {CURRENCY} as cur, {any_in('bare', HT_LABELS)} as is_ht, {any_in('bare', TVA_LABELS)} as is_tva, {any_in('bare', TTC_LABELS)} as is_ttc from $lines"""

STATEMENTS = [
    Statement("ext26_tokens", "Tokens of each line: amounts, dates, codes, addresses.",
        f"select doc_id, line_index, @n(text, {rx(AMOUNT)}) as n_amounts, cast({amount(first('text', AMOUNT))} as double) as first_amount, {first('bare', DATE)} as first_date, {first('text', PRODUCT_CODE)} as code, {first('text', EMAIL)} as email, {first('text', PHONE)} as phone from $lines"),
    Statement("ext01_text_fields", "Fields by patterns over the whole text of a document.",
        f"""with t as (select doc_id, min(case when @m(text, {rx(NUMBER)}) and @m({group('text', NUMBER)}, ~'[0-9]') then line_index end) as number_at, min(case when {group('text', ORDER)} is not null then line_index end) as order_at, min(case when {group('text', TAX_ID)} is not null then line_index end) as tax_at, min(case when {CURRENCY} is not null then line_index end) as currency_at from $lines group by doc_id)
select t.doc_id, max(case when line_index = number_at then {group('text', NUMBER)} end) as invoice_number, max(case when line_index = order_at then {group('text', ORDER)} end) as purchase_order, max(case when line_index = tax_at then {group('text', TAX_ID)} end) as tax_id, max(case when line_index = currency_at then {CURRENCY} end) as currency from t join $lines l on l.doc_id = t.doc_id group by t.doc_id"""),
    Statement("ext02_line_candidates", "Candidates of labelled lines in several wordings; rows of a table give totals only.",
        f"""with r as ({LABEL_RULES}),
v as (select doc_id, line_index, case when d is not null and {DUE} and not row_like then d end as due_date, case when d is not null and not {DUE} and not is_order_context and contains(bare, 'date') and not row_like then d end as invoice_date,
 case when not row_like and @m({group('text', NUMBER)}, ~'[0-9]') then {group('text', NUMBER)} end as invoice_number, case when not row_like and @m({group('text', ORDER)}, ~'[0-9]') then {group('text', ORDER)} end as purchase_order_number,
 case when is_ht then cast(a as string) end as amount_ht, case when is_tva then cast(a as string) end as tva_amount, case when is_tva and contains(text, '%') then {group('text', '([0-9]{1,2}(?:[,.][0-9]{1,2})?) *%')} end as tax_rate, case when is_ttc then cast(a as string) end as amount_ttc,
 case when not row_like then cur end as currency, is_ttc from r),
c as (select doc_id, line_index, k.field, case k.field when 'due_date' then due_date when 'invoice_date' then invoice_date when 'invoice_number' then invoice_number when 'purchase_order_number' then purchase_order_number when 'amount_ht' then amount_ht when 'tva_amount' then tva_amount when 'tax_rate' then tax_rate when 'amount_ttc' then amount_ttc else currency end as value,
 case when k.field = 'currency' and is_ttc then 82 else k.score end as score from v cross join (select * from (values ('due_date',80),('invoice_date',78),('invoice_number',86),('purchase_order_number',82),('amount_ht',86),('tva_amount',82),('tax_rate',78),('amount_ttc',90),('currency',58)) as t(field,score)) k)
select doc_id, line_index, field, value, score from c where value is not null"""),
    Statement("ext03_following_lines", "A label, then its value in the same line or the next two.",
        f"""with o as (select *, concat(coalesce(lead(text, 1) over w, ''), ' ', coalesce(lead(text, 2) over w, '')) as following from $lines window w as (partition by doc_id order by line_index))
select doc_id, line_index, case when {DUE} then 'due_date' when {DATED} then 'invoice_date' when {any_in('bare', ('invoice number', 'invoice no', 'invoice #', 'facture n'))} then 'invoice_number' else 'purchase_order_number' end as field,
 case when {DUE} or {DATED} then coalesce({first('bare', DATE)}, {first('following', DATE)}) when {any_in('bare', ('invoice number', 'invoice no', 'invoice #', 'facture n'))} then coalesce({group('text', NUMBER)}, {first('following', '[A-Z]{2,}-[0-9]+')}) else {group('text', ORDER)} end as value
from o where not is_order_context and ({DUE} or {DATED} or {any_in('bare', ('invoice number', 'invoice no', 'invoice #', 'facture n', 'po number', 'purchase order', 'bon de commande', 'order number'))})"""),
    Statement("ext04_block_sequence", "The same over blocks in reading order, with the block's confidence in the score.",
        f"""with o as (select *, concat(coalesce(lead(text, 1) over w, ''), ' ', coalesce(lead(text, 2) over w, '')) as following from $lines window w as (partition by doc_id order by page_number, line_index))
select doc_id, line_index, case when {DUE} then 'due_date' else 'invoice_date' end as field, coalesce({first('bare', DATE)}, {first('following', DATE)}) as value, cast(least(1.0, case when {DUE} then 0.86 else 0.88 end + confidence * 0.08) as double) as score
from o where not is_order_context and ({DUE} or {DATED}) and coalesce({first('bare', DATE)}, {first('following', DATE)}) is not null"""),
    Statement("win07_label_values", "Labels with the next two lines.", "select doc_id, line_index, node_type, next_one, next_two from (select *, lead(text, 1) over w as next_one, lead(text, 2) over w as next_two from $lines window w as (partition by doc_id order by line_index)) o where node_type like '%label'"),
    Statement("win08_stacked_totals", "Three or more amounts within seven lines after a label of totals; the first such label of a document.",
        f"""with o as (select doc_id, line_index, bare, concat_ws(' | ', {', '.join(f'lead(text, {i}) over w' for i in range(1, 8))}) as following from $lines window w as (partition by doc_id order by line_index)),
m as (select doc_id, line_index, @all(following, {rx(r'[0-9]+[.][0-9]{2,3}')}) as found from o where bare in ('total', 'totals', 'subtotal', 'total ht') or {any_in('bare', ('net worth', 'gross worth', 'total htva'))}),
f as (select *, row_number() over (partition by doc_id order by line_index) as place from m where @cnt(found, true) >= 3)
select doc_id, line_index, found[@base] as amount_ht, found[@base + 1] as tva_amount, @cnt(found, true) as n_amounts from f where place = 1""".replace("@base", "@one()")),
    Statement("jon08_spatial_dates", "The date nearest to a date label among the next seven boxes of its page.",
        f"""with o as (select *, {ORDERED} as i, {first('bare', DATE)} as d from $lines),
p as (select l.doc_id, l.line_index, v.d as value, abs(v.y1 - l.y1) + greatest(0, v.x1 - l.x2) * 0.3e0 as cost, v.i as vi from o l join o v on v.doc_id = l.doc_id and v.page_number = l.page_number and v.i between l.i + 1 and l.i + 7
 where ({DUE.replace('is_due_context', 'l.is_due_context').replace('bare', 'l.bare')} or l.is_invoice_label) and l.d is null and v.d is not null and (abs(v.x1 - l.x1) < 160 or (v.x1 >= l.x1 - 20 and v.y1 >= l.y1 - 10)))
select doc_id, line_index, value, cost from (select *, row_number() over (partition by doc_id, line_index order by cost, vi) as place from p) q where place = 1"""),
    Statement("ext07_spatial_dates", "Dates beside or near their label, with the scores of either.",
        f"""select doc_id, line_index, case when {DUE} then 'due_date' else 'invoice_date' end as field, {first('bare', DATE)} as value, case when {DUE} then 88 else 90 end as score from $lines where ({DUE} or {DATED}) and {first('bare', DATE)} is not null
union all select l.doc_id, l.line_index, 'due_date', {first('v.bare', DATE)}, 87 from $lines l join $lines v on v.doc_id = l.doc_id and v.page_number = l.page_number and v.line_index = l.line_index + 1 where l.is_due_label and {first('l.bare', DATE)} is null and {first('v.bare', DATE)} is not null"""),
    Statement("jon09_party_window", "The first lines below a party label in its column, up to the next label or total (fourteen at most, as the rule says).",
        """with l as (select *, (x1 + x2) / 2.0e0 as c, row_number() over (partition by doc_id, case when is_customer_label then 1 else 0 end order by page_number, y1, x1) as nth from $lines), m as (select doc_id, page_number, max(x2) as max_x from $lines group by doc_id, page_number),
w as (select a.doc_id, a.line_index as label_index, b.line_index, b.text, b.y1, b.x1, case when b.is_customer_label or b.is_supplier_label or contains(b.bare, 'invoice') or contains(b.bare, 'facture') or contains(b.bare, 'total') then 1 else 0 end as stops
 from l a join m on m.doc_id = a.doc_id and m.page_number = a.page_number join l b on b.doc_id = a.doc_id and b.page_number = a.page_number and b.y1 > a.y1 + 5 and abs(b.c - a.c) <= greatest(180.0e0, m.max_x * 0.28e0) where a.is_customer_label and a.nth = 1),
s as (select *, sum(stops) over (partition by doc_id, label_index order by y1, x1, line_index rows between unbounded preceding and current row) as stopped, row_number() over (partition by doc_id, label_index order by y1, x1, line_index) as place from w)
select doc_id, label_index, line_index, text from s where stopped = 0 and place <= 14"""),
    Statement("ext10_party_fields", "Name, tax id, e-mail and phone from the lines of a party window.",
        f"""select doc_id, line_index, case when is_email then 'email' when {any_in('bare', ('tax id', 'matricule', 'mf', 'vat', 'identifiant'))} then 'tax_id' when is_phone then 'phone' when is_company then 'name' when is_address then 'address' end as field,
 case when is_email then {first('text', EMAIL)} when {any_in('bare', ('tax id', 'matricule', 'mf', 'vat', 'identifiant'))} then {group('text', TAX_ID)} when is_phone then {first('text', PHONE)} else t end as value,
 case when is_email then 86 when {any_in('bare', ('tax id', 'matricule', 'mf', 'vat', 'identifiant'))} then 90 when is_phone then 80 when is_company then 92 when is_address then 84 end as score from $lines where page_number = 1 and y1 between 130 and 200"""),
    Statement("jon10_safe_header", "The first company of the upper page for each role, scored by its distance to the nearest label above.",
        """with m as (select doc_id, max(x2) as max_x, max(y2) as max_y from $lines group by doc_id), h as (select l.*, (x1 + x2) / 2.0e0 as c, max_x from $lines l join m on m.doc_id = l.doc_id where l.page_number = 1 and l.y1 <= max_y * 0.55e0),
c as (select doc_id, line_index, text, y1, x1, c, case when c <= max_x * 0.58e0 then 'supplier' else 'customer' end as role from h where is_company and not is_forbidden_party and not is_product_row),
f as (select * from (select *, row_number() over (partition by doc_id, role order by y1, x1, line_index) as place from c) q where place = 1),
d as (select f.doc_id, f.role, min(abs(f.y1 - b.y2) + abs(f.c - b.c) * 0.15e0) as distance from f join h b on b.doc_id = f.doc_id and b.y1 <= f.y1 and (case when f.role = 'supplier' then b.is_supplier_label else b.is_customer_label end) group by f.doc_id, f.role)
select f.doc_id, f.role, f.text as value, case when d.distance < 260 then 70 else 58 end as score from f left join d on d.doc_id = f.doc_id and d.role = f.role""",
        # One pass: a document's companies and labels as arrays, judged once its extent is known.
        """with a as (select doc_id, max(x2) as max_x, max(y2) as max_y, collect_list(case when page_number = 1 and not is_product_row and is_company then named_struct('y1', y1, 'x1', x1, 'line_index', line_index, 'text', text, 'c', (x1 + x2) / 2.0e0) end) as companies,
 collect_list(case when page_number = 1 then case when is_supplier_label or is_customer_label then named_struct('y1', y1, 'y2', y2, 'c', (x1 + x2) / 2.0e0, 'supplier', is_supplier_label, 'customer', is_customer_label) end end) as labels from $lines where doc_id is not null group by doc_id),
h as (select doc_id, max_x, max_y, filter(companies, x -> x.y1 <= max_y * 0.55e0) as companies, filter(labels, x -> x.y1 <= max_y * 0.55e0) as labels from a),
f as (select doc_id, k.role, labels, array_min(filter(companies, x -> (case when x.c <= max_x * 0.58e0 then 'supplier' else 'customer' end) = k.role)) as f from h cross join (select * from (values ('supplier'), ('customer')) as t(role)) k)
select doc_id, role, f.text as value, case when array_min(transform(filter(labels, b -> b.y1 <= f.y1 and case when role = 'supplier' then b.supplier else b.customer end), b -> abs(f.y1 - b.y2) + abs(f.c - b.c) * 0.15e0)) < 260 then 70 else 58 end as score from f where f is not null"""),
    Statement("ext20_amount_after_label", "The amount on a label's line, percentages left out.",
        f"with r as ({LABEL_RULES}) select doc_id, line_index, case when is_ht then 'amount_ht' when is_tva then 'tva_amount' else 'amount_ttc' end as field, cast(a as double) as amount from r where (is_ht or is_tva or is_ttc) and a is not null"),
    Statement("agg05_totals_cluster", "Labelled amounts of a document, the last of each label; the greatest total stands in for a missing one.",
        f"""with r as (select *, {LAST_AMOUNT} as a from $lines), k as (select doc_id, line_index, a, {any_in('bare', HT_LABELS)} as is_ht, {any_in('bare', TVA_LABELS)} as is_tva, {any_in('bare', TTC_LABELS)} as is_ttc, {any_in('bare', ('total', 'due', 'ttc'))} as totals_like from r where a is not null)
select doc_id, cast(max_by(case when is_ht then a end, case when is_ht then line_index end) as double) as amount_ht, cast(max_by(case when is_tva and not is_ht then a end, case when is_tva and not is_ht then line_index end) as double) as tva_amount,
 cast(coalesce(max_by(case when is_ttc and not is_ht and not is_tva then a end, case when is_ttc and not is_ht and not is_tva then line_index end), max(case when totals_like then a end)) as double) as amount_ttc from k group by doc_id"""),
    Statement("ext08_corner_totals", "The three greatest amounts of the lower right corner.",
        f"""with a as (select doc_id, cast({amount('text')} as double) as a, line_index from $lines where x1 > 450 and y1 > 500 and @m(text, {rx('[0-9]')})), r as (select *, row_number() over (partition by doc_id order by a desc, line_index) as place, count(*) over (partition by doc_id) as n from a where a is not null)
select doc_id, max(case when place = 3 then a end) as amount_ht, max(case when place = 2 then a end) as tva_amount, max(case when place = 1 then a end) as amount_ttc from r where n >= 3 group by doc_id"""),
    Statement("ext13_memory_boost", "Candidates that corrections confirmed gain 0.16; score at most 1.",
        "with m as (select distinct field, proposed from $proposals where accepted and proposed is not null) select c.document_id, c.field, c.ordinal, cast(least(1.0, c.score + case when m.proposed is not null then 0.16 else 0 end) as double) as score, m.proposed is not null as boosted from $candidates c left join m on m.field = c.field and m.proposed = c.value"),
    Statement("ext14_relevance", "Scores by the type of document.", "select document_id, field, ordinal, cast(score + case when field = 'invoice_number' and document_type = 'receipt' and (@starts(upper(value), 'BL') or @starts(upper(value), 'DN')) then 0.10 else 0 end - case when field in ('amount_ht', 'tva_amount', 'amount_ttc', 'tax_rate') and document_type <> 'invoice' then 0.08 else 0 end as double) as score from $candidates"),
    Statement("ext15_dates_ranked", "Dates ranked anew by whether they parse and by their source.",
        f"""select document_id, field, ordinal, value, cast(greatest(0.0, least(1.0, score - case when not coalesce(@m(value, {rx('^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$')}), false) then 0.5 else 0 end - case when contains(source, 'table') or contains(source, 'row') then 0.25 else 0 end
 + case when {any_in('source', ('label', 'spatial', 'graph'))} then 0.06 else 0 end - case when field = 'invoice_date' and {any_in('source', ('due', 'echeance', 'date limite'))} then 0.35 else 0 end - case when field = 'due_date' and {any_in('source', ('invoice date', 'issue date'))} then 0.30 else 0 end)) as double) as score from $candidates where field in ('invoice_date', 'due_date')"""),
    Statement("ext16_amounts_ranked", "Amounts ranked anew by evidence and plausibility.",
        f"""with a as (select *, {amount('value')} as a from $candidates where field in ('amount_ht', 'tva_amount', 'amount_ttc', 'tax_rate'))
select document_id, field, ordinal, cast(a as double) as amount, cast(greatest(0.0, least(1.0, score + case when {any_in('source', ('totals block', 'document graph totals', 'semantic totals', 'consistent total'))} then 0.12 else 0 end - case when field = 'amount_ttc' and contains(source, 'sum of reconstructed line totals') then 0.15 else 0 end
 - case when field = 'amount_ttc' and contains(source, 'subtotal') then 0.25 else 0 end - case when field = 'amount_ht' and {any_in('source', ('amount due', 'grand total', 'ttc'))} then 0.25 else 0 end - case when field = 'tax_rate' and a > 100 then 0.80 else 0 end - case when field <> 'tax_rate' and a <= 0 then 0.40 else 0 end)) as double) as score from a where a is not null"""),
    Statement("ext17_selected", "The best candidate of each field; of equals the first.", "select document_id, field, value, cast(score as double) as score, source from (select *, row_number() over (partition by document_id, field order by score desc, ordinal) as place from $candidates where value is not null) r where place = 1"),
    Statement("win16_best_values", "The best candidate of each field as one row a document (no sort: the greatest pair).", "select document_id, max(case when field = 'invoice_number' then score end) as best_number, max(case when field = 'amount_ttc' then score end) as best_total, count(value) as n_candidates from $candidates group by document_id"),
    Statement("ext18_collisions", "One date for both fields: the less certain goes; one party for both roles: likewise.",
        """with i as (select document_id, value, score, source from $candidates where field = 'invoice_date' and ordinal = 1), d as (select document_id, value, score, source from $candidates where field = 'due_date'),
p as (select document_id, max(case when ordinal = 1 then lower(trim(value)) end) as s, max(case when ordinal = 2 then lower(trim(value)) end) as c from $candidates where field = 'party_name' group by document_id)
select i.document_id, i.value = d.value as same_date, case when i.value = d.value then case when contains(d.source, 'due') and i.score <= d.score then 'invoice_date' else 'due_date' end end as dropped, coalesce(p.s = p.c, false) as same_party from i join d on d.document_id = i.document_id join p on p.document_id = i.document_id"""),
    Statement("ext19_fallback", "The selected value, else one by pattern.", "select document_id, coalesce(max(case when ordinal = 1 then value end), max(case when ordinal = 3 then value end)) as invoice_number, max(case when ordinal = 1 then value end) is null as fell_back from $candidates where field = 'invoice_number' group by document_id"),
    Statement("agg06_currency_votes", "Currency by the sum of votes, totals weigh 0.20 more.", "select document_id, value, cast(votes as double) as votes from (select *, row_number() over (partition by document_id order by votes desc, value) as place from (select document_id, value, sum(score + case when contains(source, 'total') then 0.20 else 0 end) as votes from $candidates where field = 'currency' and value is not null group by document_id, value) v) r where place = 1"),
    Statement("ext21_best_company", "The best company line of a document.",
        f"""with s as (select doc_id, line_index, t, 60 + case when @m(bare, {rx(r'\b(?:ltd|llc|inc|gmbh|sarl|sa|sas|bv|nv|corp|company|group)\b')}) then 25 else 0 end + case when upper(text) = text and @cnt(@words(text), true) >= 2 then 8 else 0 end + case when not is_address then 7 else 0 end as score from $lines where is_company)
select doc_id, t as company, score from (select *, row_number() over (partition by doc_id order by score desc, t desc, line_index) as place from s) r where place = 1"""),
    Statement("ext22_fallback_regions", "Up to three regions to read again, by what a document lacks.",
        "select document_id, @codes(case when supplier_pred is null or customer_pred is null then 'parties' end, case when count_pred = 0 then 'table' end, case when ttc_pred is null or abs(ht_pred + tva_pred - ttc_pred) > 0.05 then 'totals' end) as regions from $runs"),
    Statement("ext23_zones", "Zones by fractions of the page.",
        """with m as (select doc_id, page_number, max(x2) as w, max(y2) as h from $lines group by doc_id, page_number)
select l.doc_id, l.line_index, case when y1 < h * 0.22e0 and x1 < w * 0.5e0 then 'supplier' when y1 < h * 0.22e0 then 'metadata' when y1 < h * 0.38e0 and x1 >= w * 0.38e0 then 'customer' when y1 < h * 0.70e0 and not @m(l.bare, ~'(?:total|tva|vat|tax)') then 'products' when y1 < h * 0.88e0 and x1 >= w * 0.45e0 then 'totals' when y1 < h * 0.92e0 then 'payment' else 'footer' end as zone
from $lines l join m on m.doc_id = l.doc_id and m.page_number = l.page_number"""),
    Statement("ext25_logical_blocks", "Logical blocks: box, number of lines and mean confidence by kind of line and page.",
        f"""with k as (select *, {KIND} as kind from $lines)
select doc_id, page_number, kind, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as n, round(cast(sum(confidence) as double) / count(*), 3) as confidence from k where kind is not null group by doc_id, page_number, kind"""),
    Statement("win09_relevant_context", "Relevant lines with their neighbours.", "select doc_id, line_index, text from (select *, max(case when is_total_label or is_subtotal_label or is_invoice_label then 1 else 0 end) over (partition by doc_id order by line_index rows between 1 preceding and 1 following) as near from $lines) o where near = 1"),
    Statement("win12_until_footer", "Lines below the header of a table up to the first footer.",
        "with s as (select doc_id, page_number, line_index, text, max(case when is_table_header then 1 else 0 end) over w as started, max(case when is_document_total or is_footer then 1 else 0 end) over w as stopped, is_table_header from $lines window w as (partition by doc_id, page_number order by y1, x1, line_index rows between unbounded preceding and current row)) select doc_id, line_index, text from s where started = 1 and stopped = 0 and not is_table_header"),
    Statement("win15_top_parties", "The ten best party candidates of a document by plausibility and position.", "select doc_id, line_index, place from (select *, row_number() over (partition by doc_id order by party_plausibility desc, y1, x1, line_index) as place from $lines where is_company) r where place <= 10"),
    Statement("win17_reindexed", "Lines numbered anew after merging, first occurrence of text and place kept.",
        """with d as (select *, row_number() over (partition by doc_id, page_number, lower(t), round_half_even(x1 / 8.0e0), round_half_even(y1 / 8.0e0) order by line_index) as again from $lines) select doc_id, line_index, row_number() over (partition by doc_id order by page_number, line_index) - 1 as new_index from d where again = 1""".replace("round_half_even(", "@even(")),
    Statement("win20_vertical_blocks", "Blocks of lines, new after a gap of more than 44.", "select doc_id, page_number, cast(block as bigint) as block, count(*) as n, min(line_index) as first_line from (select *, sum(jump) over (partition by doc_id, page_number order by y1, x1, line_index rows between unbounded preceding and current row) as block from (select *, case when y1 - lag(y1) over (partition by doc_id, page_number order by y1, x1, line_index) > 44 then 1 else 0 end as jump from $lines) g) b group by doc_id, page_number, block"),
    Statement("jon02_right_of_label", "The nearest line right of a label on its row.",
        "with p as (select l.doc_id, l.line_index, v.line_index as value_index, v.text as value, v.x1 - l.x2 as gap from $lines l join $lines v on v.doc_id = l.doc_id and v.page_number = l.page_number and v.line_index <> l.line_index where l.node_type like '%label' and abs(v.y1 - l.y1) < 25 and v.x1 >= l.x2) select doc_id, line_index, value_index, value from (select *, row_number() over (partition by doc_id, line_index order by gap, value_index) as place from p) r where place = 1"),
    Statement("jon03_below_label", "The nearest line below a label.",
        "with p as (select l.doc_id, l.line_index, v.line_index as value_index, v.text as value, v.y1 - l.y2 as gap from $lines l join $lines v on v.doc_id = l.doc_id and v.page_number = l.page_number where l.node_type like '%label' and v.y1 >= l.y2 and abs(v.x1 - l.x1) < 120) select doc_id, line_index, value_index, value from (select *, row_number() over (partition by doc_id, line_index order by gap, value_index) as place from p) r where place = 1"),
    Statement("jon04_numbers_near", "Amounts within 260 of a total's label.",
        "select l.doc_id, l.line_index, v.line_index as value_index, round(sqrt(cast((v.x1 - l.x1) * (v.x1 - l.x1) + (v.y1 - l.y1) * (v.y1 - l.y1) as double)), 3) as distance from $lines l join $lines v on v.doc_id = l.doc_id and v.page_number = l.page_number and v.line_index <> l.line_index where (l.is_total_label or l.is_subtotal_label) and v.is_amount and (v.x1 - l.x1) * (v.x1 - l.x1) + (v.y1 - l.y1) * (v.y1 - l.y1) <= 67600"),
    Statement("jon06_best_amount", "The amount of least penalty for a label: distance less the bonus of its relation.",
        "with p as (select l.doc_id, l.line_index, v.line_index as value_index, v.text as value, sqrt(cast((v.x1 - l.x2) * (v.x1 - l.x2) + (v.y1 - l.y1) * (v.y1 - l.y1) as double)) * 0.01e0 - case when abs(v.y1 - l.y1) <= 8 and v.x1 >= l.x2 then 0.35e0 when v.y1 > l.y2 and abs(v.x1 - l.x1) <= 20 then 0.24e0 else 0.12e0 end as penalty from $lines l join $lines v on v.doc_id = l.doc_id and v.page_number = l.page_number and v.line_index <> l.line_index where (l.is_total_label or l.is_subtotal_label or l.is_tax_label) and v.is_amount and abs(v.y1 - l.y1) <= 200) select doc_id, line_index, value_index, value, round(penalty, 6) as penalty from (select *, row_number() over (partition by doc_id, line_index order by penalty, value_index) as place from p) r where place = 1"),
    Statement("jon13_expanded", "Selected lines and those close below them.",
        "select distinct l.doc_id, l.line_index from $lines l join $lines s on s.doc_id = l.doc_id and s.page_number = l.page_number and (s.is_customer_label or s.is_total_label) and l.y1 - s.y1 between 0 and 70 and abs(l.x1 - s.x1) < 180"),
    Statement("jon14_header_merge", "Lines of one row within 18 of each other, joined.",
        "select a.doc_id, a.line_index, count(*) as n, min(b.line_index) as first_line from $lines a join $lines b on b.doc_id = a.doc_id and b.page_number = a.page_number and abs((a.y1 + a.y2) - (b.y1 + b.y2)) <= 36 group by a.doc_id, a.line_index"),
    Statement("jon16_nearest_numeric", "The number nearest to a column's place, within 75.",
        "with t as (select doc_id, page_number, line_index, (x1 + x2) / 2.0e0 as c, y1 from $lines where is_subtotal_label or is_tax_label or is_total_label), p as (select t.doc_id, t.line_index, v.line_index as value_index, abs((v.x1 + v.x2) / 2.0e0 - (t.c + 135)) + 0.25e0 * abs(v.y1 - t.y1) as cost from t join $lines v on v.doc_id = t.doc_id and v.page_number = t.page_number and v.is_amount and abs((v.x1 + v.x2) / 2.0e0 - (t.c + 135)) <= 75) select doc_id, line_index, value_index, round(cost, 4) as cost from (select *, row_number() over (partition by doc_id, line_index order by cost, value_index) as place from p) r where place = 1"),
    Statement("jon27_memory_context", "Corrected values that stand in a line, with the text around them.",
        "with m as (select distinct c_name from $customers) select l.doc_id, l.line_index, m.c_name, substr(l.text, 1, 160) as context from $lines l join m on m.c_name = @rep(l.t, ~' (?:Inc|Trading|Medical)$', '')"),
    Statement("jon31_merged_lines", "Lines read twice merged: the first by text and rounded place stays.",
        "with u as (select doc_id, page_number, lower(t) as k, x1, y1, line_index, 0 as again from $lines union all select doc_id, page_number, lower(t), x1 + 1, y1, line_index, 1 from $lines where page_number = 1 and line_index % 3 = 0), d as (select *, row_number() over (partition by doc_id, page_number, k, @even(x1 / 8.0e0), @even(y1 / 8.0e0) order by again, line_index) as place from u) select doc_id, line_index, again from d where place = 1"),
    Statement("agg01_mean_confidence", "Mean confidence of a document's lines, three digits.", "select doc_id, round(cast(sum(confidence) as double) / count(*), 3) as confidence from $lines group by doc_id"),
    Statement("agg40_alignment", "Alignment of most lines and mean density.",
        "with m as (select doc_id, page_number, max(x2) as w from $lines group by doc_id, page_number), a as (select l.doc_id, case when (x1 + x2) / 2.0e0 < 0.36e0 * w then 'left' when (x1 + x2) / 2.0e0 > 0.64e0 * w then 'right' else 'center' end as side, length(text) as chars, (x2 - x1) * (y2 - y1) as area from $lines l join m on m.doc_id = l.doc_id and m.page_number = l.page_number), c as (select doc_id, side, count(*) as n, sum(chars) as chars, sum(area) as area from a group by doc_id, side) select doc_id, side as alignment, n from (select *, row_number() over (partition by doc_id order by n desc, side) as place from c) r where place = 1"),
]
