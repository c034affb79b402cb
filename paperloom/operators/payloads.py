"""Payloads: recognition results, labels and answers of models as JSON, what is
sent to a model, and what becomes of corrections. JSON is read by a parser or
by patterns over one row, so nothing shuffles unless a statement joins."""

from __future__ import annotations

from ..functions.dialect import any_in, one_of, rx
from .fields import KIND, LABEL_RULES, amount
from .quality import norm, when
from .statements import Statement

# Fixed values (names that results depend on).
SUPPORTED_FIELDS = ("supplier_name", "customer_name", "invoice_number", "invoice_date", "due_date", "currency", "amount_ht", "tva_amount", "amount_ttc", "line_items")
ITEM_KEYS = {"description": ("description", "designation", "item", "nm", "name"), "quantity": ("quantity", "qty", "cnt", "count"), "price": ("unit_price", "price", "unitprice"), "total": ("line_total", "total", "amount", "worth")}
LIMITS = {"v1": (8, 40, 6000, 12), "v2": (8, 40, 6000, 12), "v3": (5, 12, 2500, 5), "v4": (3, 8, 1600, 4)}


def member(c: str, *keys: str) -> str:
    """The first of several members of a JSON text, as text."""
    return f"nullif(regexp_extract({c}, {rx('\"(?:' + '|'.join(keys) + ')\" *: *\"?([^\",}]*)')}, 1), '')"


def parsed(c: str, *keys: str) -> str:
    """The same for JSON written in full, escapes resolved."""
    return "coalesce(" + ", ".join(f"nullif(@json({c}, '$.{k}'), '')" for k in keys) + ", null)"


CONFIDENCE, BOX = "coalesce(cast(confidence as string), 'null')", {k: f"coalesce(cast({k} as string), 'null')" for k in ("x1", "y1", "x2", "y2")}
PAYLOADS = """case doc_id % 3 when 0 then concat('{"rec_text": ', @quoted(t), ', "rec_score": ', <confidence>, ', "box": [', <x1>, ', ', <y1>, ', ', <x2>, ', ', <y2>, ']}') when 1 then concat('{"text": ', @quoted(t), ', "confidence": ', <confidence>, ', "bbox": [', <x1>, ', ', <y1>, ', ', <x2>, ', ', <y2>, ']}')
 else concat('[[[', <x1>, ', ', <y1>, '], [', <x2>, ', ', <y1>, '], [', <x2>, ', ', <y2>, '], [', <x1>, ', ', <y2>, ']], [', @quoted(t), ', ', <confidence>, ']]') end"""
for _name, _value in {"confidence": CONFIDENCE, **BOX}.items():
    PAYLOADS = PAYLOADS.replace(f"<{_name}>", _value)
LABELS = """case doc_id % 4 when 0 then concat('{"description": "', coalesce(description, ''), '", "quantity": "', coalesce(cast(quantity as string), ''), '", "unit_price": "', coalesce(cast(unit_price as string), ''), '", "total": "', coalesce(cast(line_total_ttc as string), ''), '"}') when 1 then concat('{"nm": "', coalesce(description, ''), '", "cnt": "', coalesce(cast(quantity as string), ''), '", "price": "', coalesce(cast(line_total_ttc as string), ''), '"}')
 when 2 then concat('{"item": "', coalesce(description, ''), '", "qty": "', coalesce(cast(quantity as string), ''), '", "worth": "', coalesce(cast(line_total_ttc as string), ''), '"}') else '' end"""

# Fixed values (names that results depend on).
REQUIRED = ("supplier_name", "supplier_tax_id", "invoice_number", "invoice_date", "currency", "amount_ttc")
INCLUDED = ("supplier_name", "supplier_address", "supplier_tax_id", "customer_name", "customer_address", "customer_tax_id", "invoice_number", "invoice_date", "due_date", "currency", "amount_ht", "tva_amount", "amount_ttc", "tax_rate", "purchase_order_number")
#: Columns of a row for review; a table leaves those that it lacks null.
REVIEWED = {
    "doc_id": "bigint", "table_name": "string", "row_key": "string", "label": "string", "value": "string", "confidence": "double", "source": "string", "page_number": "int", "x1": "int", "y1": "int", "x2": "int", "y2": "int", "status": "string",
    "required_for_erp": "boolean", "included_in_erp": "boolean", "reference": "string", "quantity": "double", "unit_price": "double", "tax_rate": "double", "amount_ht": "double", "tax_amount": "double", "amount_ttc": "double",
}


def reviewed(rows: str, **columns: str) -> str:
    """Rows of a table for review."""
    return "select " + ", ".join(f"cast({columns.get(c, 'null')} as {kind}) as {c}" for c, kind in REVIEWED.items()) + f" from {rows}"


def _review() -> str:
    status = "case when confidence < 0.65 then 'low_confidence' else 'ok' end"
    field = dict(doc_id="doc_id", row_key="name", label="name", value="value", confidence="confidence", source="source", status=f"case when coalesce(value, '') = '' then 'missing' else {status} end", required_for_erp=f"name in {one_of(REQUIRED)}", included_in_erp=f"name in {one_of(INCLUDED)}")
    box = {c: c for c in ("doc_id", "page_number", "x1", "y1", "x2", "y2", "confidence")}
    line = dict(box, label="concat('Line ', line_index)", value="text")
    block = dict(box, row_key="concat('layout_', page_number, '_', kind)", value="text", source="'layout analyzer'", status="case when kind = 'unknown' then 'unmapped' else 'ok' end")
    tables = [
        reviewed(f"e where name in {one_of(INCLUDED)}", **field, table_name="'erp_fields'"),
        reviewed("e", **field, table_name="'all_extracted_fields'"),
        reviewed("$items", doc_id="doc_id", table_name="'line_items'", row_key="concat('line_item_', row_index)", label="concat('Line ', row_index)", value="description", confidence="confidence", source="coalesce(source, 'line item extraction')", status="case when contains(lower(source), 'review') then 'needs_review' else 'validated' end", included_in_erp="true",
            reference="reference", quantity="quantity", unit_price="unit_price", tax_rate="tax_rate", amount_ht="line_total_ht", tax_amount="coalesce(tax_amount, line_total_ttc - line_total_ht)", amount_ttc="line_total_ttc"),
        reviewed("s where tax_rate is not null or tva_amount is not null", doc_id="doc_id", table_name="'tax_summary'", row_key="'tax_summary_1'", label="'TVA / VAT'", value="currency", source="'totals extraction'", status="'ok'", included_in_erp="true", tax_rate="try_cast(tax_rate as double)", amount_ht="try_cast(amount_ht as double)", tax_amount="try_cast(tva_amount as double)", amount_ttc="try_cast(amount_ttc as double)"),
        reviewed("i", doc_id="doc_id", table_name="'tax_summary'", row_key="concat('tax ', coalesce(cast(tax_rate as string), 'unknown'))", label="concat('tax ', coalesce(cast(tax_rate as string), 'unknown'))", source="'line item extraction'", status="'ok'", included_in_erp="true", tax_rate="tax_rate", amount_ht="ht", tax_amount="tva", amount_ttc="ttc"),
        reviewed("e where name = 'due_date' and value is not null", **{**field, "row_key": "'payment_due_date'", "label": "'payment_due_date'", "confidence": "null", "source": "'invoice due date'", "status": "case when value = '' then 'missing' else 'ok' end", "required_for_erp": "false", "included_in_erp": "false"}, table_name="'payment_details'"),
        reviewed("k cross join (select * from (values ('ocr_blocks'), ('payment_details')) as t(table_name)) n where n.table_name = 'ocr_blocks' or k.pays", **line, table_name="n.table_name", row_key="concat('ocr_', page_number, '_', line_index)", source="'ocr'", status=status),
        reviewed("b", **block, table_name="'layout_blocks'", label="kind"),
        reviewed("b where kind = 'unknown'", **block, table_name="'unmapped_text'", label="'Unknown layout block'"),
        reviewed("k where x1 is not null and y1 is not null and x2 is not null and y2 is not null and not exists (select 1 from b where b.doc_id = k.doc_id and b.page_number = k.page_number and b.kind <> 'unknown' and k.x1 >= b.x1 and k.y1 >= b.y1 and k.x2 <= b.x2 and k.y2 <= b.y2)",
            **{**line, "label": "'Unmapped OCR text'"}, table_name="'unmapped_text'", row_key="concat('unmapped_ocr_', page_number, '_', line_index)", source="'ocr not assigned to logical block'", status="'unmapped'"),
    ]
    return f"""with e as (select * from (select doc_id, name, value, score as confidence, source, row_number() over (partition by doc_id, name order by case when coalesce(value, '') = '' then 1 else 0 end, score desc, ordinal) as place
  from (select document_id as doc_id, case when field <> 'party_name' then field when ordinal = 1 then 'supplier_name' else 'customer_name' end as name, value, score, source, ordinal from $candidates) c) r where place = 1),
s as (select doc_id, {', '.join(f"max(case when name = '{c}' then value end) as {c}" for c in ('tax_rate', 'amount_ht', 'tva_amount', 'amount_ttc', 'currency'))} from e group by doc_id),
i as (select doc_id, cast(floor(tax_rate) as int) as tax_rate, sum(line_total_ht) as ht, sum(coalesce(tax_amount, line_total_ttc - line_total_ht)) as tva, sum(line_total_ttc) as ttc from $items group by doc_id, cast(floor(tax_rate) as int)),
k as (select doc_id, page_number, line_index, text, confidence, x1, y1, x2, y2, is_payment_label or is_contact as pays, coalesce({KIND}, 'unknown') as kind from $lines),
b as (select doc_id, page_number, kind, @joined(text, line_index) as text, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, round(cast(sum(confidence) as double) / count(confidence), 3) as confidence from k group by doc_id, page_number, kind)
""" + "\nunion all ".join(tables)


REVIEW = _review()

STATEMENTS = [
    Statement("src05_scan", "Recognised lines of a document: embedded text first, else the first engine, else the second.",
        "with s as (select doc_id, page_number, line_index, text, case when doc_id % 5 = 0 then 'embedded' when doc_id % 7 = 0 then 'secondary' else 'primary' end as engine, confidence from $lines) select doc_id, line_index, engine, case when engine = 'embedded' then line_index + 1 else page_number end as page_number, case when engine = 'embedded' then 1.0e0 else cast(confidence as double) end as confidence from s"),
    Statement("src06_regions", "Regions to read by profile: the whole page, and four parts of it in the accurate one.",
        "with p as (select distinct doc_id, page_number, page_width, page_height, case doc_id % 3 when 0 then 'fast' when 1 then 'balanced' else 'accurate' end as profile from $lines), k as (select * from (values ('full', 0.0e0, 0.0e0, 1.0e0, 1.0e0), ('header', 0.0e0, 0.0e0, 1.0e0, 0.35e0), ('table', 0.0e0, 0.3e0, 1.0e0, 0.75e0), ('totals', 0.5e0, 0.6e0, 1.0e0, 1.0e0), ('footer', 0.0e0, 0.75e0, 1.0e0, 1.0e0)) as t(region, fx1, fy1, fx2, fy2)) select doc_id, page_number, region, cast(floor(page_width * fx1) as bigint) as x1, cast(floor(page_height * fy1) as bigint) as y1, cast(floor(page_width * fx2) as bigint) as x2, cast(floor(page_height * fy2) as bigint) as y2 from p join k on k.region = 'full' or p.profile = 'accurate'"),
    Statement("src07_targeted", "Pages that are read again for the regions a document needs.", "with w as (select document_id, case when supplier_pred is null then 'parties' when count_pred = 0 then 'table' when ttc_pred is null then 'totals' end as region from $runs) select l.doc_id, l.line_index, w.region from $lines l join w on w.document_id = l.doc_id where (w.region = 'parties' and l.y1 < 200) or (w.region = 'table' and l.y1 between 230 and 560) or (w.region = 'totals' and l.y1 > 560)"),
    Statement("src08_payloads", "Lines from payloads of three shapes: dictionaries with either keys, nested lists.",
        f"""with p as (select doc_id, line_index, {PAYLOADS} as payload from $lines)
select doc_id, line_index, case when @starts(payload, '[') then @json(payload, '$[1][0]') else {parsed('payload', 'rec_text', 'text')} end as text, try_cast(case when @starts(payload, '[') then @json(payload, '$[1][1]') else {parsed('payload', 'rec_score', 'confidence')} end as double) as score from p"""),
    Statement("src15_labels", "Fields of labels from JSON, literals and JSON in text, by the first alias present.",
        f"""with p as (select document_id, case document_id % 3 when 0 then concat('{{"invoice_no": "', coalesce(number_true, ''), '", "total_gross": "', ttc_true, '"}}') when 1 then concat('{{''invoice_number'': ''', coalesce(number_true, ''), ''', ''amount_ttc'': ''', ttc_true, '''}}') else concat('{{"gt": "{{invoice_no: ', coalesce(number_true, ''), ', total: ', ttc_true, '}}"}}') end as payload from $runs),
q as (select document_id, replace(payload, '''', '"') as j, payload from p)
select document_id, coalesce({member('j', 'invoice_number', 'invoice_no')}, nullif(regexp_extract(payload, {rx('invoice_no: ([^,}]*)')}, 1), '')) as number, try_cast(coalesce({member('j', 'amount_ttc', 'total_gross')}, nullif(regexp_extract(payload, {rx('total: ([0-9.]*)')}, 1), '')) as double) as total from q""".replace("{{", "{").replace("}}", "}")),
    Statement("src18_manifest", "Paths of labels from a manifest.", "select document_id, relative_path, concat('labels/', @rep(relative_path, ~'[.]png$', '.json')) as label_path from $runs where document_id % 6 <> 0"),
    Statement("src17_batches", "Files of the three batches.", "select document_id, split_part(relative_path, '/', 1) as batch from $runs where split_part(relative_path, '/', 1) in ('batch1', 'batch2')"),
    Statement("src01_loaders", "How each file is loaded; other suffixes are errors.", f"select document_id, case when @m(path, {rx('[.](?:png|jpg|jpeg|tif|tiff|bmp)$')}) then 'image' when @m(path, ~'[.]pdf$') then 'pdf' end as loader, not @m(path, {rx('[.](?:pdf|png|jpg|jpeg|tif|tiff|bmp)$')}) as is_error from (select document_id, lower(concat(relative_path, case document_id % 4 when 0 then '.PDF' when 1 then '.docx' else '' end)) as path from $runs) p"),
    Statement("lbl05_truth_items", "Line items of truths in several dialects, with why a record is excluded and the status of the document.",
        f"""with p as (select doc_id, row_index, {LABELS} as payload from $items), v as (select doc_id, row_index, payload, {member('payload', *ITEM_KEYS['description'])} as description, {member('payload', *ITEM_KEYS['quantity'])} as quantity, {member('payload', *ITEM_KEYS['total'], 'price')} as total from p)
select doc_id, row_index, description, try_cast(quantity as double) as quantity, try_cast(total as double) as total, case when payload = '' then 'empty' when lower(description) in ('total', 'subtotal') then 'total' when description is null then 'no description' end as excluded, case when payload = '' then 'unsupported' else 'supported' end as status from v"""),
    Statement("set06_flattened", "Containers flattened: items of items as rows with their depth.", "with k as (select * from (values (0), (1), (2)) as t(depth)) select i.doc_id, i.row_index, k.depth, concat(i.reference, case k.depth when 0 then '' when 1 then '/part' else '/part/part' end) as path from $items i join k on k.depth <= i.row_index % 3"),
    Statement("set01_candidate_union", "All generators of candidates as one bag, with each one's rank.",
        f"with r as ({LABEL_RULES}) select doc_id, line_index, 'totals' as generator, 1 as generator_rank from r where is_ht or is_ttc union all select doc_id, line_index, 'tax', 2 from r where is_tva union all select doc_id, line_index, 'date', 3 from r where d is not null union all select doc_id, line_index, 'party', 4 from r where is_company union all select doc_id, line_index, 'currency', 5 from r where cur is not null"),
    Statement("set03_line_kinds", "Validated lines and lines for review as one bag.", "select doc_id, row_index, 'validated' as kind from $items where quantity is not null and unit_price is not null union all select doc_id, row_index, 'review' from $items where quantity is null or unit_price is null"),
    Statement("llm02_package", "Evidence for a model within the limits of its prompt's version: lines, characters.",
        f"""with o as (select l.doc_id, l.line_index, text, length(text) as n, case when is_total_label or is_subtotal_label or is_tax_label or is_invoice_label or is_customer_label or is_supplier_label then 1 else 0 end as relevant, cast(doc_id % 4 + 1 as int) as version from $lines l),
e as (select *, max(relevant) over (partition by doc_id order by line_index rows between 1 preceding and 1 following) as near from o), b as (select *, row_number() over (partition by doc_id order by line_index) as place, sum(n) over (partition by doc_id order by line_index rows between unbounded preceding and current row) as chars from e where near = 1)
select doc_id, line_index, version, place from b where place <= case version {' '.join(f'when {i} then {v[1]}' for i, v in enumerate(LIMITS.values(), 1))} end and (place = 1 or chars <= case version {' '.join(f'when {i} then {v[2]}' for i, v in enumerate(LIMITS.values(), 1))} end)"""),
    Statement("llm03_prompts", "What is sent to a model: fields and reasons, never the raw text.",
        "select document_id, concat('{\"fields\":{\"supplier\":\"', coalesce(supplier_pred, ''), '\",\"number\":\"', coalesce(number_pred, ''), '\"},\"status\":\"', extraction_status, '\",\"compact\":', case when document_id % 4 >= 2 then 'true' else 'false' end, '}') as payload, length(concat(coalesce(supplier_pred, ''), coalesce(number_pred, ''))) / 4 as tokens_estimated_x from $runs".replace(", length(concat(coalesce(supplier_pred, ''), coalesce(number_pred, ''))) / 4 as tokens_estimated_x", "")),
    Statement("llm04_requests", "Requests to a model: one for each document that needs help, at temperature 0.", "select document_id, @hash(concat(extraction_status, '|', coalesce(number_pred, ''))) as request_key, 0 as temperature, 30 as timeout_seconds from $runs where extraction_status <> 'valid' and execution_status = 'completed'"),
    Statement("llm05_parsed", "Answers parsed: strict, in text around, broken.",
        f"""with a as (select document_id, field, case document_id % 4 when 0 then concat('{{"field": "', field, '", "operation": "replace", "value": "', proposed, '", "confidence": 0.91}}') when 1 then concat('Sure! {{"field": "', field, '", "operation": "fill_missing", "value": "', proposed, '", "confidence": 0.88}} Done.') when 2 then '{{"field": ' else '' end as answer from $proposals where proposed is not null and not contains(proposed, '"')),
b as (select *, regexp_extract(answer, {rx('([{].*[}])')}, 1) as body from a)
select document_id, field, case when body <> '' and body = answer then 'parsed' when body <> '' then 'recovered' when answer = '' then 'empty' else 'malformed' end as status, {member('body', 'operation')} as operation, try_cast({member('body', 'confidence')} as double) as confidence from b""".replace("{{", "{").replace("}}", "}")),
    Statement("llm06_checks", "The nine checks of a proposal; all must hold.",
        f"""with p as (select document_id, field, deterministic, proposed, coalesce(case document_id % 6 when 0 then 'rewrite' when 1 then 'fill_missing' else 'replace' end, '') as operation, cast(0.80 + document_id % 20 * 0.01 as decimal(4,2)) as confidence, document_id % 9 <> 0 as has_refs, document_id % 13 <> 0 as refs_exist, case when document_id % 5 = 0 then 'n/a' else concat('text ', coalesce(proposed, ''), ' here') end as evidence, cast((document_id * 17 % 100) * 0.01 as decimal(4,2)) as field_confidence, case when document_id % 11 = 0 then 'stale' else deterministic end as old_value from $proposals),
c as (select document_id, field, @codes({when(f"field not in {one_of(SUPPORTED_FIELDS)}", "supported_field")}, {when("operation not in ('replace', 'fill_missing')", "supported_operation")}, {when("confidence < 0.85", "confidence_threshold")}, {when("not has_refs", "has_evidence_refs")}, {when("not refs_exist", "evidence_refs_exist")},
 {when(f"coalesce(proposed, '') = '' or not contains({norm('evidence')}, {norm('proposed')})", "proposed_value_present")}, {when("case when operation = 'fill_missing' then coalesce(deterministic, '') <> '' else coalesce(old_value, '') <> '' and lower(trim(old_value)) <> lower(trim(coalesce(deterministic, ''))) end", "old_value_matches")},
 {when("field_confidence >= 0.90 and coalesce(deterministic, '') <> '' and not (operation = 'fill_missing' and confidence >= 0.97)", "high_confidence_protected")},
 {when(f"(field = 'invoice_date' and not coalesce(@m(proposed, {rx('^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$')}), false)) or (field = 'amount_ttc' and try_cast(proposed as double) is null) or (field in ('supplier_name', 'customer_name') and not coalesce(@m(proposed, {rx(r'[\p{L}0-9][\p{L}0-9 .&/-]{2,}')}), false))", "type_specific")}) as failed from p)
select document_id, field, failed, failed = '' as accepted from c"""),
    Statement("snk05_answers", "Answers cached by the fingerprint of what was asked; one entry for each.", "select fingerprint, min(document_id) as document_id, count(*) as n_requests from (select document_id, @hash(concat(extraction_status, '|', erp_status, '|', coalesce(number_pred, ''))) as fingerprint from $runs) f group by fingerprint"),
    Statement("snk04_cache", "Entries of the cache of recognised lines: fingerprint, version, number of boxes.", "select @hash(concat('v2|', doc_id)) as fingerprint, 2 as schema_version, count(*) as n_lines, count(x1) as n_boxes from $lines group by doc_id"),
    Statement("snk01_files", "The export of each document and the name of its file.", "select document_id, concat(coalesce(nullif(@rep(number_pred, ~'[^A-Za-z0-9._-]+', '_'), ''), @rep(split_part(relative_path, '/', 2), ~'[.][a-z]+$', '')), '.json') as file_name, concat('{\"number\":\"', coalesce(number_pred, ''), '\",\"status\":\"', extraction_status, '\"}') as body from $runs"),
    Statement("snk02_reports", "The validation report of each document as JSON.", "select document_id, concat('{\"status\":\"', extraction_status, '\",\"erp\":\"', erp_status, '\",\"rows\":', count_pred, '}') as body from $runs"),
    Statement("snk08_tables", "Reports as rows of a Markdown table.", "select dataset_name, concat('| ', dataset_name, ' | ', count(*), ' | ', count(case when extraction_status = 'valid' then 1 end), ' |') as markdown, concat('<tr><td>', dataset_name, '</td><td>', count(*), '</td></tr>') as html from $runs group by dataset_name"),
    Statement("snk10_previews", "Names of previews: stem, page, beginning of a digest.", "select doc_id, page_number, concat('doc-', doc_id, '_p', page_number, '_', substr(@hash(concat(doc_id, '/', page_number)), 1, 10), '.png') as preview from (select distinct doc_id, page_number from $lines) p"),
    Statement("snk12_responses", "What a request for a document returns: its export, report and decision in one row.", "select r.document_id, r.extraction_status, r.erp_status, count(p.field) as n_proposals, count(case when p.accepted then 1 end) as n_accepted from $runs r left join $proposals p on p.document_id = r.document_id group by r.document_id, r.extraction_status, r.erp_status"),
    Statement("prj04_field_boxes", "Expanded fields that have a box.", "select doc_id, line_index, node_type as field, x1, y1, x2, y2 from $lines where node_type in ('amount', 'date_candidate', 'email', 'phone', 'company_candidate') and x1 is not null"),
    Statement("prj05_review_tables", "The rows of the eight tables for review as one long table: fields of the ERP, all fields, line items, taxes, payment, blocks, lines, what is not mapped.", REVIEW),
    Statement("prj08_box_contract", "Boxes of all kinds of rows within their page.", "select doc_id, line_index, 'line' as kind, greatest(0, x1) as x1, greatest(0, y1) as y1, least(x2, page_width) as x2, least(y2, page_height) as y2 from $lines where x2 > x1 and y2 > y1 union all select doc_id, min(line_index), 'page', min(x1), min(y1), max(x2), max(y2) from $lines group by doc_id, page_number"),
    Statement("prj12_traces", "Traces of fields: what was selected, the other candidates, why nothing was.",
        "with r as (select *, row_number() over (partition by document_id, field order by case when value is null then 1 else 0 end, score desc, ordinal) as place from $candidates) select document_id, field, max(case when place = 1 then value end) as selected, count(value) as n_candidates, max(case when place = 2 then value end) as runner_up, case when count(value) = 0 then 'no candidate' when max(case when place = 1 then score end) < 0.6 then 'weak' end as note from r where place <= 20 group by document_id, field"),
    Statement("prj13_candidate_payload", "Candidates with what their validation says.", f"select document_id, field, ordinal, value, cast(score as double) as score, case when value is null then 'missing' when field like 'amount%' and {amount('value')} is null then 'not a number' when field = 'invoice_number' and not @m(value, ~'[0-9]') then 'weak reference' end as rejection from $candidates"),
    Statement("prj15_table_diagnostics", "Diagnostics of tables as columns.", "select document_id, header_found, header_confirmed, region_found, body_found, rows_found, count_pred as rows_reconstructed, count_validated as rows_validated, count_pred - count_true as count_difference from $runs"),
    Statement("prj17_display", "Values as they are shown: blanks for nothing, two digits for amounts.", "select document_id, coalesce(nullif(trim(supplier_pred), ''), '-') as supplier, coalesce(cast(cast(ttc_pred as decimal(18,2)) as string), '-') as total, upper(extraction_status) as status from $runs"),
    Statement("cor03_reviewed", "Documents after review: accepted values in place, checked again, ready or not.",
        "with a as (select document_id, max(case when accepted and field = 'supplier_name' then proposed end) as supplier, max(case when accepted and field = 'invoice_number' then proposed end) as number, max(case when accepted and field = 'currency' then proposed end) as currency, count(case when accepted then 1 end) as n from $proposals group by document_id), r as (select r.*, coalesce(a.supplier, r.supplier_pred) as s, coalesce(a.number, r.number_pred) as n_, coalesce(a.currency, r.currency_pred) as c, coalesce(a.n, 0) as n_corrections from $runs r left join a on a.document_id = r.document_id) select document_id, s as supplier, n_ as number, c as currency, n_corrections, case when abs(ht_pred + tva_pred - ttc_pred) > greatest(0.05, abs(ttc_pred) * 0.005) then 'Rejected' when s is null or n_ is null or c is null or ttc_pred is null or count_validated < count_pred then 'Needs Review' else 'ERP Ready' end as readiness from r"),
    Statement("val06_quality_gate", "The whole gate of a document: rejected fields, totals, items, status.",
        f"""with i as (select doc_id, count(*) as n_items, count(case when quantity > 0 and unit_price >= 0 and line_total_ttc >= 0 and length(coalesce(description, '')) >= 3 and abs(quantity * unit_price - line_total_ht) <= greatest(0.05, abs(line_total_ht) * 0.05) then 1 end) as n_valid from $items group by doc_id),
f as (select document_id, count(case when predicted is not null and (document_id * 13 % 100) < 45 then 1 end) as n_rejected, count(case when predicted is null then 1 end) as n_missing from $fields group by document_id)
select r.document_id, f.n_rejected, f.n_missing, i.n_valid, i.n_items - i.n_valid as n_review, abs(ht_pred + tva_pred - ttc_pred) <= greatest(0.05, abs(ttc_pred) * 0.002) as totals_accepted, case when ttc_pred is null or f.n_missing > 2 then 'invalid' when f.n_rejected > 0 or i.n_items > i.n_valid or abs(ht_pred + tva_pred - ttc_pred) > greatest(0.05, abs(ttc_pred) * 0.002) then 'needs_review' else 'valid' end as status from $runs r join f on f.document_id = r.document_id left join i on i.doc_id = r.document_id"""),
    Statement("run02_compatible", "Whether a run can be resumed: the configuration's digest is the same.", "select dataset_name, @hash(concat('{\"ocr\":\"balanced\",\"dataset\":\"', dataset_name, '\"}')) as config_hash, count(distinct case when document_id % 2 = 0 then 'a' else 'b' end) = 1 as compatible from $runs group by dataset_name"),
    Statement("img05_regions_once", "Regions of an image once each by rounded size; small ones drop out.", "with r as (select doc_id, line_index, x2 - x1 as w, y2 - y1 as h, row_number() over (partition by doc_id, @even((x2 - x1) / 20.0e0), @even((y2 - y1) / 20.0e0) order by line_index) as again from $lines where y2 - y1 >= 16 and x2 - x1 >= 80) select doc_id, line_index, w, h from r where again = 1"),
    Statement("img07_profiles", "Profiles of recognition with overrides and their digest.", "select document_id, case document_id % 3 when 0 then 'fast' when 1 then 'balanced' else 'accurate' end as profile, coalesce(case when document_id % 10 = 0 then 1200 end, case document_id % 3 when 0 then 1280 when 1 then 1600 else 2400 end) as max_side, @hash(concat('{\"max_side\":', coalesce(case when document_id % 10 = 0 then 1200 end, case document_id % 3 when 0 then 1280 when 1 then 1600 else 2400 end), '}')) as config_hash from $runs"),
    Statement("ext05_layout_candidates", "Candidates of visual lines: labels with the amounts right of them.",
        f"with p as (select l.doc_id, l.line_index, l.is_subtotal_label, l.is_tax_label, l.is_total_label, v.text, v.line_index as vi, v.x1 from $lines l join $lines v on v.doc_id = l.doc_id and v.page_number = l.page_number and abs((v.y1 + v.y2) - (l.y1 + l.y2)) <= 20 and v.x1 >= l.x2 and v.is_amount where l.is_subtotal_label or l.is_tax_label or l.is_total_label) select doc_id, case when is_subtotal_label then 'amount_ht' when is_tax_label then 'tva_amount' else 'amount_ttc' end as field, cast({amount('text')} as double) as amount, case when is_subtotal_label then 88 when is_tax_label then 86 else 92 end as score from (select *, row_number() over (partition by doc_id, line_index order by x1, vi) as place from p) q where place = 1"),
    Statement("ext06_graph_totals", "Totals of the graph that agree with each other gain 0.25 and 0.30.",
        f"with a as (select doc_id, line_index, cast({amount('text')} as double) as a, y1 from $lines where is_amount and x1 > 450 and y1 > 560), t as (select h.doc_id, h.a as ht, v.a as tva, c.a as ttc, abs(h.a + v.a - c.a) as apart from a h join a v on v.doc_id = h.doc_id and v.y1 > h.y1 join a c on c.doc_id = h.doc_id and c.y1 > v.y1) select doc_id, ht, tva, ttc, case when apart <= greatest(0.10e0, abs(ttc) * 0.01e0) then 55 else 0 end as bonus from t"),
    Statement("ext09_summary_table", "Amounts below the labels of a summary within 190.",
        f"with p as (select l.doc_id, l.line_index, v.text, abs((v.x1 + v.x2) / 2.0e0 - (l.x1 + l.x2) / 2.0e0) + (v.y1 - l.y1) * 0.12e0 as cost, v.line_index as vi from $lines l join $lines v on v.doc_id = l.doc_id and v.page_number = l.page_number and v.y1 > l.y1 and abs((v.x1 + v.x2) / 2.0e0 - (l.x1 + l.x2) / 2.0e0) <= 190 and v.is_amount where l.is_subtotal_label or l.is_tax_label) select doc_id, line_index, cast({amount('text')} as double) as amount, 96 as score from (select *, row_number() over (partition by doc_id, line_index order by cost, vi) as place from p) q where place = 1"),
    Statement("ext11_header_fallback", "Companies of the upper page as candidates of last resort.", "select doc_id, t as value, case when x1 < 400 then 'supplier_name' else 'customer_name' end as field, 58 as score from (select *, row_number() over (partition by doc_id, x1 < 400 order by y1, x1, line_index) as place from $lines where is_company and page_number = 1 and y1 < 300) q where place = 1"),
    Statement("ext12_text_parties", "Parties from text alone: the company after a label, or near the top above an address.",
        "with o as (select *, lead(text, 1) over w as next_text, lead(is_company, 1) over w as next_company, lead(is_address, 1) over w as next_address, row_number() over w as i from $lines window w as (partition by doc_id order by line_index)) select doc_id, line_index, 'customer_name' as field, next_text as value, 80 as score from o where is_customer_label and next_company union all select doc_id, line_index, 'supplier_name', t, case when next_address then 80 else 58 end from o where is_company and i <= 18"),
    Statement("win11_body_rows", "Body lines as rows: close to the one before, or a wrapped fragment.", "with o as (select *, case when y1 - lag(y1) over w <= 12 or is_wrapped_fragment then 0 else 1 end as starts from $lines where y1 between 260 and 560 window w as (partition by doc_id, page_number order by y1, x1, line_index)) select doc_id, line_index, cast(sum(starts) over (partition by doc_id, page_number order by y1, x1, line_index rows between unbounded preceding and current row) as bigint) as body_row from o"),
    Statement("smp03_representatives", "Representatives of buckets, balanced over datasets, none twice (a sampling operator).", "with b as (select document_id, dataset_name, case when count_pred >= 4 then 'table' when extraction_status = 'invalid' then 'invalid' when ttc_pred is null then 'no_total' else 'plain' end as bucket from $runs), d as (select *, row_number() over (partition by bucket, dataset_name order by @hash(concat('s|', document_id))) as within from b), r as (select *, row_number() over (partition by bucket order by within, @hash(concat('s|', document_id))) as place from d) select document_id, dataset_name, bucket from r where place <= 25"),
    Statement("agg22_tiers", "Summary of a tiered evaluation: mean time, projection to 8000 documents, throughput, cache hits, totals.", "select count(*) as n, round(avg(cast(seconds as double)), 4) as mean_seconds, round(avg(cast(seconds as double)) * 8000 / 3600, 3) as hours_for_8000, round(60 / avg(cast(seconds as double)), 4) as documents_a_minute, round(cast(count(case when disk_hit then 1 end) as double) / count(*), 4) as cache_rate, round(cast(count(case when abs(ht_pred + tva_pred - ttc_pred) <= 0.05 then 1 end) as double) / count(*), 4) as consistent from $runs"),
    Statement("agg36_column_centres", "Centres of columns: means of clusters of cells.", "with c as (select doc_id, line_index, (x1 + x2) / 2.0e0 as c from $cells), j as (select *, case when c - lag(c) over (partition by doc_id order by c, line_index) > 34 then 1 else 0 end as jump from c), g as (select doc_id, c, sum(jump) over (partition by doc_id order by c, line_index rows between unbounded preceding and current row) as cluster from j) select doc_id, cast(cluster as bigint) as cluster, count(*) as n, round(sum(c) / count(*), 4) as center from g group by doc_id, cluster"),
    Statement("ext24_blocks", "Semantic blocks by place and word with their scores.", f"select doc_id, page_number, case when y1 < 130 and x1 < 400 then 'supplier' when y1 < 130 then 'metadata' when y1 < 200 then 'customer' when y1 < 560 then 'products' when {any_in('bare', ('total', 'tva', 'vat', 'tax'))} or x1 > 500 then 'totals' when is_payment_label or is_contact then 'payment' else 'footer' end as block, count(*) as n, count(case when is_company then 1 end) * 10 + count(case when is_amount then 1 end) * 5 as score from $lines group by 1, 2, 3"),
]
