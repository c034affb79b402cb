"""Gates, failure codes, label checks and decisions over one document, one
field or one proposal: narrow statements without a shuffle, unless said."""

from __future__ import annotations

from ..functions.dialect import any_in, one_of, rx
from ..functions.predicates import TABLE_HEADER_VALUES
from .statements import Statement

# Fixed values (names, thresholds and lists that results depend on).
FIELD_CONFIDENCE = {"supplier_name": "0.45", "customer_name": "0.55", "invoice_number": "0.62", "purchase_order_number": "0.58", "amount_ht": "0.58", "tva_amount": "0.58", "amount_ttc": "0.62", "tax_rate": "0.55"}
CATEGORY_BY_PREFIX = {"EXECUTION_": "execution", "DOCUMENT_TYPE_": "document_classification", "MISSING_": "required_field", "PARTY_": "party", "INVOICE_NUMBER_": "invoice_number", "CURRENCY_": "currency", "TTC_": "totals", "TOTALS_": "totals", "TAX_": "totals", "HT_": "totals", "NO_": "line_items", "TABLE_": "line_items", "HIGH_": "confidence", "OCR_": "confidence", "REQUIRED_": "confidence"}
PARTY_LABELS = ("ship to", "bill to", "customer", "client", "supplier", "vendor", "seller")
PARTY_TABLE = ("unit price", "unit prico", "quantity", "description", "total", "amount", "vat", "tva")
COMPANY_TOKENS = ("inc", "ltd", "llc", "sarl", "sa", "sas", "corp", "company", "distribution", "pharma", "medical", "trading")
NORM = f"trim(@rep(lower({{0}}), {rx(r'[^\p{L}\p{N}]+')}, ' '))"
RATES = "least(abs(tax_rate - 0), abs(tax_rate - 7), abs(tax_rate - 10), abs(tax_rate - 13), abs(tax_rate - 19), abs(tax_rate - 20)) > 0.5"


def norm(c: str) -> str:
    return NORM.replace("{0}", c)


def when(condition: str, code: str) -> str:
    return f"case when {condition} then '{code}' end"


def word_in(c: str, words) -> str:
    return f"@m({c}, {rx('(^| )(?:' + '|'.join(words) + ')( |$)')})"


LINE_GATE = Statement(
    "val03_line_gate",
    "Line items: reasons against each, and whether it is accepted.",
    f"""
with c as (select *, coalesce(trim(description), '') as d, @strip(@bare(lower(coalesce(description, ''))), ' :#-_') as plain, cast(quantity * unit_price as decimal(24,6)) as expected, coalesce(line_total_ht, line_total_ttc) as compared from $items),
r as (select doc_id, row_index, @codes(
  {when("contains(lower(source), 'review')", "low_confidence_table")}, {when(f"length(d) < 3 or length(@rep(d, {rx('[^' + chr(92) + 'p{L}]')}, '')) < 3", "weak_description")},
  {when(f"d <> '' and (plain in {one_of(TABLE_HEADER_VALUES)} or @m(d, {rx('^[A-Za-z0-9+/=_-]{18,}$')}))", "header_or_token")},
  {when("quantity is null or quantity <= 0", "quantity")}, {when("unit_price is null or unit_price < 0", "unit_price")}, {when("line_total_ttc is null or line_total_ttc < 0", "total")},
  {when("abs(expected - compared) > greatest(0.05, abs(compared) * 0.05)", "arithmetic")}, {when("abs(line_total_ht + tax_amount - line_total_ttc) > greatest(0.05, abs(line_total_ttc) * 0.01)", "ttc")},
  {when(RATES, "tax_rate")}, {when("source = 'flexible numeric row' and coalesce(confidence, 0) < 0.75", "fallback_row")}) as reasons from c)
select doc_id, row_index, reasons, reasons = '' as accepted from r""",
)

FIELD_GATE = Statement(
    "val04_field_gate",
    "Field values: the first reason that rejects each; a rejected value is null but stays as candidate.",
    f"""
with f as (select document_id, field, trim(predicted) as value, @strip(@bare(lower(trim(predicted))), ' :#-_') as plain, cast((document_id * 13 % 100) * 0.01 as decimal(4,2)) as confidence,
  case field {" ".join(f"when '{k}' then {v}" for k, v in FIELD_CONFIDENCE.items())} else 0.35 end as least_confidence from $fields),
r as (select *, case when value is null or value = '' then null when confidence < least_confidence then 'low confidence'
  when plain in {one_of(TABLE_HEADER_VALUES)} or @m(lower(value), {rx('^(?:acct_|cus_|tok_|pi_|cs_)[a-z0-9_-]{8,}$')}) or @m(value, {rx('^[A-Za-z0-9+/=_-]{18,}$')}) then 'unsafe value'
  when field in ('invoice_number', 'supplier_name', 'customer_name') and @m(value, {rx('^[A-Za-z]{1,3}$')}) then 'unsafe value'
  when field in ('supplier_name', 'customer_name') and {any_in("plain", ("subtotal", "sales tax", "shipping", "amount due", "total due", "quantity", "description", "price", "total", "montant"))} then 'unsafe value'
  when field = 'invoice_number' and not (@m(value, {rx('[0-9]')}) and @m(upper(value), {rx('^[A-Z0-9][A-Z0-9_./-]{3,}$')})) then 'weak reference'
  when field in ('supplier_name', 'customer_name') and (length(value) < 4 or length(@rep(value, {rx('[^' + chr(92) + 'p{L}]')}, '')) < 3) then 'weak party name' end as reason from f)
select document_id, field, case when reason is null then value end as value, case when reason is not null then value end as rejected_candidate, reason from r""",
)

TOTALS_GATE = Statement(
    "val05_totals_gate",
    "Whether a document's totals and its tax rate agree, and why not.",
    """
with t as (select document_id, ht_pred as ht, tva_pred as tva, ttc_pred as ttc, cast(document_id % 21 as decimal(6,2)) as tax_rate from $runs),
c as (select *, abs(ht + tva - ttc) as mismatch, case when ht <> 0 then round(cast(tva as double) / cast(ht as double) * 100, 2) end as computed from t)
select document_id, computed, case when mismatch > greatest(0.05, abs(ttc) * 0.002) then 'inconsistent totals' when abs(computed - cast(tax_rate as double)) > 0.75e0 then 'inconsistent tax rate' when """
    + RATES
    + """ then 'suspicious tax rate' end as reason from c""",
)

FAILURE_CODES = Statement(
    "ftx01_failure_codes",
    "Failure codes of each run, their categories and the primary one.",
    f"""
with p as (select *, {norm("supplier_pred")} as sn, {norm("customer_pred")} as cn, trim(coalesce(number_pred, '')) as num from $runs),
m as (select *, (coalesce(supplier_pred, '') = '' or coalesce(customer_pred, '') = '' or coalesce(number_pred, '') = '' or coalesce(date_pred, '') = '' or coalesce(currency_pred, '') = '' or ttc_pred is null or count_pred <= 0) as some_missing, coalesce(overall_confidence >= 0.85, false) as high from p),
x as (select document_id, execution_status = 'completed' as done,
  @codes({when("execution_status = 'failed'", "EXECUTION_EXCEPTION")}, {when("execution_status = 'interrupted'", "EXECUTION_INTERRUPTED")}, {when("execution_status = 'timeout'", "EXECUTION_TIMEOUT")}) as early,
  @codes({when("lower(document_type) in ('', 'unknown', 'other')", "DOCUMENT_TYPE_UNKNOWN")}, {when("high and extraction_status in ('invalid', 'needs_review')", "HIGH_CONFIDENCE_INVALID_EXTRACTION")}, {when("ht_pred > ttc_pred", "HT_TTC_CONFUSION")},
  {when(f"@m(num, {rx('^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$')})", "INVOICE_NUMBER_DATE_LIKE")}, {when(f"ttc_pred is not null and num = concat('', ttc_pred)", "INVOICE_NUMBER_TOTAL_LIKE")}, {when(f"@m(num, {rx('^(?:19|20)[0-9]{2}$')})", "INVOICE_NUMBER_YEAR_ONLY")},
  {when("ttc_pred is null", "MISSING_AMOUNT_TTC")}, {when("coalesce(currency_pred, '') = ''", "MISSING_CURRENCY")}, {when("coalesce(customer_pred, '') = ''", "MISSING_CUSTOMER")}, {when("coalesce(date_pred, '') = ''", "MISSING_INVOICE_DATE")}, {when("coalesce(number_pred, '') = ''", "MISSING_INVOICE_NUMBER")},
  {when("count_pred <= 0", "MISSING_LINE_ITEMS")}, {when("coalesce(supplier_pred, '') = ''", "MISSING_SUPPLIER")}, {when("count_pred <= 0", "NO_TABLE_DETECTED")}, {when("count_validated <= 0 and count_pred > 0", "NO_VALIDATED_LINE_ITEMS")},
  {when("high and (some_missing or extraction_status = 'invalid')", "OCR_CONFIDENCE_NOT_SEMANTIC_CONFIDENCE")},
  {when(f"sn in {one_of(PARTY_LABELS)} or cn in {one_of(PARTY_LABELS)}", "PARTY_LABEL_ONLY")},
  {when(f"(not {word_in('sn', COMPANY_TOKENS)} and @cnt(@words(sn), true) <= 2) or (not {word_in('cn', COMPANY_TOKENS)} and @cnt(@words(cn), true) <= 2)", "PARTY_LOW_COMPANY_PLAUSIBILITY")},
  {when(" or ".join(f"@n({c}, ~' ') > 12 or contains({c}, '. ') or contains({c}, ': ') or contains({c}, '; ')" for c in ("trim(supplier_pred)", "trim(customer_pred)")), "PARTY_LOOKS_LIKE_SENTENCE")},
  {when("length(trim(supplier_pred)) > 80 or length(trim(customer_pred)) > 80", "PARTY_NAME_TOO_LONG")}, {when(f"@m(sn, {rx('^[0-9]{4,6}([- ]?[0-9]{2,6})?$')}) or @m(cn, {rx('^[0-9]{4,6}([- ]?[0-9]{2,6})?$')})", "PARTY_POSTAL_CODE_ONLY")},
  {when("supplier_pred <> '' and customer_pred <> '' and sn = cn", "PARTY_SUPPLIER_CUSTOMER_COLLISION")}, {when(f"sn in {one_of(PARTY_TABLE)} or cn in {one_of(PARTY_TABLE)} or {word_in('sn', [w for w in PARTY_TABLE if ' ' not in w])} or {word_in('cn', [w for w in PARTY_TABLE if ' ' not in w])}", "PARTY_TABLE_HEADER")},
  {when("high and some_missing", "REQUIRED_FIELDS_MISSING_WITH_HIGH_CONFIDENCE")}, {when("count_pred <= 0", "TABLE_ROWS_NOT_RECONSTRUCTED")}, {when("tva_pred > ttc_pred", "TAX_INCONSISTENT")}, {when("abs(ht_pred + tva_pred - ttc_pred) > greatest(0.05, ttc_pred * 0.01)", "TOTALS_INCONSISTENT")},
  {when("abs(ttc_pred) >= 10000000", "TTC_IMPLAUSIBLY_LARGE")}, {when("ttc_pred > 0 and ttc_pred < 1", "TTC_IMPLAUSIBLY_SMALL")}, {when("ttc_pred between 1900 and 2100 and ttc_pred = floor(ttc_pred)", "TTC_LOOKS_LIKE_YEAR")}) as late from m),
y as (select document_id, case when done then late else early end as codes from x)
select document_id, codes, cast(case when codes = '' then 0 else length(codes) - length(replace(codes, ',', '')) + 1 end as int) as n_codes, case when codes <> '' then split_part(codes, ',', 1) end as primary_code,
 @codes({", ".join(when(" or ".join(f"@starts(codes, '{p}') or contains(codes, ',{p}')" for p, c in CATEGORY_BY_PREFIX.items() if c == category), category) for category in sorted(set(CATEGORY_BY_PREFIX.values())))}) as categories from y""",
)

SUSPICIOUS = Statement(
    "ftx02_suspicious",
    "Suspicious parties and amounts of each run, and a warning where confidence is high all the same.",
    f"""
with n as (select *, {norm("supplier_pred")} as c, trim(supplier_pred) as t, cast(document_id % 100 as decimal(6,2)) as rate from $runs),
x as (select document_id, overall_confidence, extraction_status, coalesce(supplier_pred, '') = '' or coalesce(number_pred, '') = '' or ttc_pred is null as missing, @codes(
 {when("c in ('ship to', 'bill to', 'customer', 'supplier', 'unit price', 'quantity', 'description', 'unit prico')", "PARTY_IS_LABEL_ONLY")}, {when(any_in("c", ("quantity", "description", "unit", "price", "total", "amount", "qty", "vat", "tva")), "PARTY_IS_TABLE_HEADER")},
 {when(any_in("c", ("invoice", "facture", "date", "number", "numero", "total", "subtotal")), "PARTY_CONTAINS_METADATA_LABEL")}, {when("length(t) > 80", "PARTY_NAME_TOO_LONG")}, {when("@n(t, ~' ') > 12 or contains(t, '. ') or contains(t, ': ') or contains(t, '; ')", "PARTY_LOOKS_LIKE_SENTENCE")},
 {when(f"@n(t, {rx('[0-9]')}) > 0 and @n(t, {rx('[0-9]')}) >= greatest(3, floor(length(t) / 3.0e0))", "PARTY_EXCESSIVE_NUMERIC_CONTENT")}, {when(f"c <> '' and not {word_in('c', COMPANY_TOKENS[:-1])} and @cnt(@words(c), true) <= 2", "PARTY_LOW_COMPANY_PLAUSIBILITY")},
 {when("ttc_pred <= 0", "TTC_NON_POSITIVE")}, {when("ttc_pred between 1900 and 2100 and ttc_pred = floor(ttc_pred)", "TTC_LOOKS_LIKE_YEAR")}, {when("ttc_pred > 0 and ttc_pred <= 100 and abs(ttc_pred - rate) < 0.001", "TTC_LOOKS_LIKE_PERCENTAGE")}, {when("abs(ttc_pred) >= 10000000", "TTC_IMPLAUSIBLY_LARGE")},
 {when("tva_pred > ttc_pred", "TVA_GREATER_THAN_TTC")}, {when("ht_pred > ttc_pred", "HT_GREATER_THAN_TTC")}) as codes from n)
select document_id, codes, coalesce(overall_confidence >= 0.85, false) and (missing or extraction_status = 'invalid' or codes <> '') as confidence_warning from x""",
)

TABLE_AUDIT = Statement(
    "ftx03_table_audit",
    "Root cause of a table's failure, reason of a count mismatch, conclusion of the audit.",
    """
with g as (select *, case when count_pred = count_true then 'same_granularity' when count_pred > count_true and count_true > 0 then 'prediction_split' when count_pred < count_true and count_pred > 0 then 'prediction_merged' else 'unrelated' end as granularity from $runs)
select document_id, case when not header_found then 'header failure' when not header_confirmed and not region_found then 'header confirmation failure' when not body_found then 'body detection failure' when not rows_found then 'row reconstruction failure'
  when count_validated = 0 and count_pred > 0 then 'validation rejection' when count_pred <> count_true then 'row merge/split or ground-truth mismatch' else 'resolved' end as root_cause,
 case when truth_status not in ('supported', 'explicit_zero') then concat('truth_', truth_status) when count_pred = count_true then 'count_match' when granularity <> 'same_granularity' then granularity else 'count_mismatch' end as mismatch_reason,
 case when truth_status not in ('supported', 'explicit_zero') then concat('not_evaluated_', truth_status) when changed_by_adapter then 'truth_count_changed_by_adapter' when count_true = 0 then 'zero_items_confirmed' else 'canonical_items_supported' end as conclusion from g""",
)

LABEL_QUALITY = Statement(
    "lbl01_label_quality",
    "Verified labels: missing fields, errors, whether totals agree, whether the label counts for accuracy.",
    f"""
with l as (select *, case document_id % 4 when 0 then 'verified' when 1 then 'verified' when 2 then 'draft' else 'odd' end as status, case when document_id % 14 = 0 then 'TODO' else customer_true end as customer, case when document_id % 16 = 0 then '' else number_true end as number from $runs),
x as (select *, {norm("customer")} in ('todo', 'tbd', 'unknown', 'na', 'none', 'null', 'placeholder', 'replace me', 'a completer', 'a verifier') as placeholder, abs(ht_pred + tva_pred - ttc_true) <= greatest(0.02, abs(ttc_true) * 0.005) as agree,
 @codes({when("supplier_true is null", "supplier_name")}, {when("coalesce(customer, '') = ''", "customer_name")}, {when("coalesce(number, '') = ''", "invoice_number")}, {when("date_true is null", "invoice_date")}, {when("count_true = 0", "line_items")}) as missing from l),
y as (select *, @codes({when("status not in ('draft', 'verified', 'needs_review', 'rejected')", "status")}, {when("number = ''", "empty_string")}, {when("placeholder", "placeholder")}, {when("not agree", "totals")}, {when("status = 'verified' and missing <> ''", "required")}) as errors from x)
select document_id, status, missing, errors, agree as totals_consistent, status = 'verified' and errors = '' and missing = '' as eligible from y""",
)

FIELD_COMPARISON = Statement(
    "lbl02_field_comparison",
    "Prediction against truth by the kind of field: exact, normalised, errors of amounts.",
    f"""
with c as (select *, predicted is null or predicted = '' as missing, try_cast(predicted as double) as p, try_cast(truth as double) as t from $fields)
select document_id, field, missing, case when kind = 'count' then p = t when not missing and truth <> '' then trim(predicted) = trim(truth) end as exact_match,
 case kind when 'amount' then abs(p - t) <= greatest(0.01e0, abs(t) * 0.005e0) when 'count' then coalesce(p = t, false) when 'date' then not missing and coalesce(substr(predicted, 1, 10) = substr(truth, 1, 10), false)
  when 'currency' then not missing and coalesce(upper(trim(predicted)) = upper(trim(truth)), false) else not missing and coalesce({norm("predicted")} = {norm("truth")}, false) end as normalized_match,
 case when kind = 'amount' then round(abs(p - t), 4) end as absolute_error from c""",
)

DOCUMENT_CORRECTNESS = Statement(
    "lbl03_document_correctness",
    "Per document whether required, financial and all fields are right, false readiness, routing to review (one shuffle on the document).",
    f"""
with f as (select document_id, field, case when truth is null or truth = '' then null when kind in ('amount', 'count') then coalesce(abs(try_cast(predicted as double) - try_cast(truth as double)) <= greatest(0.02e0, abs(try_cast(truth as double)) * 0.005e0), false) else coalesce({norm("predicted")} = {norm("truth")}, false) end as correct from $fields),
d as (select document_id, bool_and(correct) as all_correct, bool_and(case when field in ('supplier_name', 'invoice_number', 'invoice_date', 'currency', 'amount_ttc') then correct end) as required_correct, bool_and(case when field in ('amount_ttc', 'currency') then correct end) as financial_correct, count(case when not correct then 1 end) as n_wrong from f group by document_id)
select d.document_id, coalesce(all_correct, false) as fully_correct, coalesce(required_correct, false) as required_correct, coalesce(financial_correct, false) as financial_correct, n_wrong,
 r.erp_status = 'ready' and not coalesce(all_correct, false) as false_ready, r.erp_status <> 'ready' and not coalesce(all_correct, false) as safely_routed from d join $runs r on r.document_id = d.document_id""",
)

GRANULARITY = Statement(
    "lbl04_granularity",
    "Whether predicted and true rows stand for the same things: by counts and matched items.",
    """
with m as (select document_id, count_pred, count_true, least(count_pred, count_true) - (case when document_id % 3 = 0 then 1 else 0 end) as matched from $runs)
select document_id, case when count_pred = 0 or count_true = 0 then 'unrelated' when count_pred = count_true and matched >= count_true then 'same_granularity' when count_pred > count_true and matched >= 1 then 'prediction_split' when count_pred < count_true and matched >= 1 then 'prediction_merged'
 when matched > 0 then 'ambiguous_granularity' else 'unrelated' end as granularity from m""",
)

CORRECTION_CLASS = Statement(
    "lbl06_correction_class",
    "Class of each proposed correction against the truth.",
    f"""
with c as (select *, {norm("coalesce(deterministic, '')")} = {norm("truth")} as det, {norm("coalesce(proposed, '')")} = {norm("truth")} as prop, {norm("coalesce(proposed, '')")} as p, {norm("coalesce(truth, '')")} as t from $proposals)
select document_id, field, accepted, case when truth is null or truth = '' then 'Unsupported correction' when prop and not det then 'Correct improvement' when prop then 'Correct but unnecessary' when accepted then 'Wrong correction'
 when proposed is not null and proposed <> '' then case when p <> '' and contains(t, p) then 'Unsupported correction' else 'Hallucination' end else 'No change' end as class from c""",
)

TRIGGER_CLASS = Statement(
    "lbl07_trigger_class",
    "Category, severity and impact of each trigger.",
    f"""
with t as (select distinct trigger_reason as trigger_name, lower(trigger_reason) as v from $proposals),
c as (select trigger_name, case when contains(v, 'confidence') then 'CONFIDENCE' when {any_in("v", ("supplier", "customer", "party"))} then 'PARTY' when {any_in("v", ("line", "table", "row"))} then 'TABLES' when {any_in("v", ("total", "amount", "financial", "validation_invalid"))} then 'TOTALS'
 when {any_in("v", ("validation", "review"))} then 'REVIEW' when {any_in("v", ("date", "invoice", "metadata"))} then 'METADATA' else 'OCR' end as category, v from t)
select trigger_name, category, case when category in ('TOTALS', 'TABLES') then 'critical' when category = 'METADATA' or (category = 'PARTY' and contains(v, 'missing')) then 'high' else 'medium' end as severity,
 case category when 'PARTY' then 'account' when 'METADATA' then 'audit trail' when 'TOTALS' then 'payment and tax' when 'TABLES' then 'inventory' when 'OCR' then 'manual review' else 'review' end as impact from c""",
)

PROFILE = Statement(
    "lbl08_profile",
    "Profile of a document from its path: batch, type, language.",
    f"""
select document_id, split_part(relative_path, '/', 1) as batch, @x(relative_path) as stem, case when contains(lower(relative_path), 'receipt') then 'receipt' when contains(lower(relative_path), 'batch0') then 'clean' when contains(lower(relative_path), 'batch1') then 'noisy' else 'photographed' end as profile from $runs""".replace("@x(relative_path)", f"@rep(split_part(relative_path, '/', 2), {rx(r'[.][a-z]+$')}, '')"),
)

ERROR_CATEGORY = Statement(
    "lbl09_error_category",
    "Category of a run's outcome.",
    """
select document_id, case when execution_status = 'timeout' then 'timeout' when execution_status <> 'completed' then 'pipeline_error' when count_pred = 0 then 'table_extraction' when ttc_pred is null then 'missing_total' when number_pred is null then 'missing_number'
 when abs(ht_pred + tva_pred - ttc_pred) > greatest(0.05, abs(ttc_pred) * 0.01) then 'totals_mismatch' when extraction_status = 'valid' then 'ok' else 'needs_review' end as category from $runs""",
)

PARTY_TAXONOMY = Statement(
    "pty09_taxonomy",
    "Taxonomy code of a comparison of names.",
    f"""
with c as (select document_id, field, predicted, truth, {norm("predicted")} as p, {norm("truth")} as t from $fields where kind = 'party'),
s as (select *, @rep(p, {rx('( (?:inc|llc|ltd|sarl|sa|sas|corp))+$')}, '') as ps, @rep(t, {rx('( (?:inc|llc|ltd|sarl|sa|sas|corp))+$')}, '') as ts from c)
select document_id, field, case when truth is null or truth = '' then 'PARTY_TRUTH_MISSING' when predicted is null or predicted = '' then 'PARTY_PREDICTION_MISSING' when p = t then 'PARTY_CANONICAL_MATCH' when ps = ts then 'PARTY_LEGAL_SUFFIX_ONLY_DIFFERENCE'
 when contains(concat(' ', t, ' '), concat(' ', p, ' ')) or contains(concat(' ', p, ' '), concat(' ', t, ' ')) then 'PARTY_PARTIAL_NAME_MATCH' else 'PARTY_TRUE_MISMATCH' end as code from s""",
)

TRIGGERS = Statement(
    "llm01_triggers",
    "Reasons to ask for help with a document, sorted.",
    f"""
select document_id, @codes({when("extraction_status <> 'valid' and abs(ht_pred + tva_pred - ttc_pred) > 0.05", "financial_inconsistency")}, {when("count_pred > count_validated", "line_items_need_review")}, {when("coalesce(overall_confidence, 0) < 0.78", "low_overall_confidence")},
 {when("ttc_pred is null", "missing_amount_ttc")}, {when("coalesce(customer_pred, '') = ''", "missing_customer_name")}, {when("coalesce(date_pred, '') = ''", "missing_invoice_date")}, {when("coalesce(number_pred, '') = ''", "missing_invoice_number")}, {when("coalesce(supplier_pred, '') = ''", "missing_supplier_name")},
 {when("extraction_status = 'invalid'", "validation_invalid")}, {when("extraction_status = 'needs_review'", "validation_needs_review")}) as reasons from $runs""",
)

ROUTER = Statement(
    "llm08_router",
    "Whether a document goes to the model, from which cache entry, or why not.",
    """
with r as (select *, @hash(concat(document_id % 1000, '|', extraction_status, '|', coalesce(number_pred, ''))) as fingerprint from $runs),
c as (select distinct fingerprint from r where document_id % 7 = 0)
select r.document_id, case when execution_status <> 'completed' then 'not completed' when extraction_status = 'valid' and coalesce(overall_confidence, 0) >= 0.78 then 'confident' when document_type = 'receipt' then 'unsupported type' end as skip_reason,
 case when execution_status <> 'completed' or document_type = 'receipt' or (extraction_status = 'valid' and coalesce(overall_confidence, 0) >= 0.78) then 'bypass' when c.fingerprint is not null then 'cached' when erp_status = 'ready' then 'validated_apply' else 'advisory' end as route
from r left join c on c.fingerprint = r.fingerprint""",
)

HYBRID = Statement(
    "llm07_hybrid",
    "A candidate with applied corrections: its confidence, and whether it improves safely.",
    """
with s as (select document_id, cast(coalesce(overall_confidence, 0) as decimal(6,4)) as before, cast(case when abs(ht_pred + tva_pred - ttc_pred) <= 0.05 then 0.95 when ttc_pred is null then 0.68 else 0.35 end as decimal(6,4)) as financial, cast(case extraction_status when 'valid' then 0.92 when 'needs_review' then 0.62 else 0.35 end as decimal(6,4)) as rows_score, cast(0.80 + document_id % 20 * 0.01 as decimal(6,4)) as proposal, extraction_status from $runs),
h as (select *, cast(proposal * 0.45 + financial * 0.35 + rows_score * 0.20 as decimal(8,4)) as hybrid from s)
select document_id, cast(hybrid as double) as hybrid_confidence, hybrid > before and financial >= 0.68 and extraction_status <> 'invalid' as improves_safely from h""",
)

SUGGESTIONS = Statement(
    "cor01_suggestions",
    "Suggested corrections: letters read for digits in numbers, rates ten times too large.",
    f"""
with n as (select document_id, replace(number_pred, '0', 'O') as seen, cast(document_id % 13 * 25 as decimal(6,2)) as tax_rate from $runs where number_pred is not null),
f as (select *, @back(@back(seen, ~'O([0-9])', '0', ''), ~'([0-9])I([0-9])', '', '1') as fixed from n)
select document_id, case when fixed <> seen then fixed end as number_suggestion, case when tax_rate > 100 then cast(tax_rate / 10 as double) end as rate_suggestion from f""",
)

VALIDATION_EXPLAINED = Statement(
    "prj09_explanation",
    "What a validation message is about and what to do.",
    f"""
with e as (select document_id, case when ttc_pred <= 0 then 'TTC must be positive' when abs(ht_pred + tva_pred - ttc_pred) > 0.05 then 'HT + TVA does not equal TTC' when ttc_pred is null then 'Missing total TTC' when number_pred is null then 'Missing invoice reference' when currency_pred is null then 'Missing currency' end as message from $runs)
select document_id, message, case when {any_in("lower(message)", ("ttc", "tva", "total"))} then 'totals' when contains(lower(message), 'reference') then 'invoice_number' when contains(lower(message), 'currency') then 'currency' end as field_hint,
 case when @starts(message, 'Missing') then 'enter the value' when message is not null then 'compare with the document' end as action from e""",
)

ROW_STATUS = Statement(
    "prj06_row_status",
    "Status of a review row: missing, low confidence or ok.",
    "select document_id, field, case when predicted is null or predicted = '' then 'missing' when document_id * 17 % 100 < 65 then 'low_confidence' else 'ok' end as row_status from $fields",
)

RISK = Statement(
    "frd01_risk_indicators",
    "Six indicators of risk and their score.",
    """
with f as (select document_id, coalesce(ttc_pred < 0, false) as negative, coalesce(abs(ht_pred + tva_pred - ttc_pred) > greatest(0.05, abs(ttc_pred) * 0.005), false) as financial, document_id % 71 = 0 as duplicate, coalesce(lower(trim(supplier_pred)) = lower(trim(customer_pred)), false) as same_party, currency_pred is null as no_currency, coalesce(number_pred, '') = '' or coalesce(supplier_pred, '') = '' as incomplete from $runs),
n as (select *, cast(negative as int) + cast(financial as int) + cast(duplicate as int) + cast(same_party as int) + cast(no_currency as int) + cast(incomplete as int) as n from f)
select document_id, n as n_indicators, least(100, 16 * n) as risk_percent, @codes(case when negative then 'negative' end, case when financial then 'financial' end, case when duplicate then 'duplicate' end, case when same_party then 'same_party' end, case when no_currency then 'no_currency' end, case when incomplete then 'incomplete' end) as indicators from n""",
)

STATEMENTS = [v for v in list(globals().values()) if isinstance(v, Statement)]
