"""Evaluation reports: aggregations, comparisons, samples and projections of
runs, fields and proposals. Each aggregates partially before its one shuffle;
limits stand only where the report is a top-k or a sample."""

from __future__ import annotations

from ..functions.dialect import any_in, rx
from .quality import norm
from .statements import Statement, rate, shared

CORRECT = f"case when truth is null or truth = '' then null when kind in ('amount', 'count') then coalesce(abs(try_cast(predicted as double) - try_cast(truth as double)) <= greatest(0.02e0, abs(try_cast(truth as double)) * 0.005e0), false) else coalesce({norm('predicted')} = {norm('truth')}, false) end"
CATEGORY = f"case when contains(trigger_reason, 'confidence') then 'CONFIDENCE' when {any_in('trigger_reason', ('supplier', 'customer', 'party'))} then 'PARTY' when {any_in('trigger_reason', ('line', 'table'))} then 'TABLES' when {any_in('trigger_reason', ('total', 'amount', 'financial'))} then 'TOTALS' when contains(trigger_reason, 'validation') then 'REVIEW' else 'METADATA' end"
CLASS = f"case when truth is null or truth = '' then 'unsupported' when {norm("coalesce(proposed, '')")} = {norm('truth')} then case when {norm("coalesce(deterministic, '')")} = {norm('truth')} then 'unnecessary' else 'improvement' end when accepted then 'wrong' when coalesce(proposed, '') <> '' then 'hallucination' else 'none' end"


STATEMENTS = [
    Statement("agg12_field_accuracy", "Accuracy by field: exact, normalised, missing, false positives.",
        f"""with c as (select *, coalesce(predicted, '') = '' as missing, {CORRECT} as ok from $fields)
select field, count(*) as n, {shared("count(case when trim(predicted) = trim(truth) then 1 end)", "count(*)")} as exact_rate, {shared("count(case when ok then 1 end)", "count(*)")} as normalized_rate, {shared("count(case when missing then 1 end)", "count(*)")} as missing_rate,
 {shared("count(case when coalesce(truth, '') = '' and not missing then 1 end)", "count(*)")} as false_positive_rate from c group by field"""),
    Statement("agg13_party_quality", "Quality of parties by field, with the distribution of classes.",
        f"""with c as (select field, predicted, truth, {norm("predicted")} as p, {norm("truth")} as t from $fields where kind = 'party'),
k as (select *, case when coalesce(predicted, '') = '' or coalesce(truth, '') = '' then 'unavailable' when p = t then 'exact' when @rep(p, {rx('( (?:inc|llc|ltd))+$')}, '') = t then 'canonical_exact' when contains(concat(' ', t, ' '), concat(' ', p, ' ')) then 'partial' else 'mismatch' end as class from c)
select field, count(*) as n, {shared("count(case when predicted = truth then 1 end)", "count(*)")} as strict_accuracy, {shared("count(case when class in ('exact', 'canonical_exact') then 1 end)", "count(*)")} as canonical_accuracy,
 count(case when class = 'partial' then 1 end) as n_partial, count(case when class = 'mismatch' then 1 end) as n_mismatch, count(case when class = 'unavailable' then 1 end) as n_unavailable from k group by field"""),
    Statement("agg14_ratios", "Ratios that leave nulls out.", f"select dataset_name, {rate('overall_confidence >= 0.5')} as confident, {rate('ttc_pred > 1000')} as large, count(overall_confidence) as n from $runs group by dataset_name"),
    Statement("agg15_count_quality", "Quality of row counts: exact, precision, recall.",
        f"""select count(*) as n, {shared("count(case when count_pred = count_true then 1 end)", "count(*)")} as count_accuracy, {shared("sum(least(count_pred, count_true))", "sum(count_pred)")} as precision_, {shared("sum(least(count_pred, count_true))", "sum(count_true)")} as recall_, cast(sum(least(count_pred, count_true)) as bigint) as matched
from $runs where truth_status = 'supported' and count_true > 0"""),
    Statement("agg16_canonical_items", "Canonical quality of line items.",
        f"""select count(*) as n, {rate("(count_pred > 0) = (count_true > 0)")} as presence, {rate("count_pred = count_true")} as exact_count, {rate("abs(count_pred - count_true) <= 1")} as within_one, round(avg(cast(abs(count_pred - count_true) as double)), 3) as mae,
 {rate("count_pred <> count_true and count_pred > 0 and count_true > 0")} as split_merge, count(case when changed_by_adapter then 1 end) as changed from $runs where truth_status in ('supported', 'explicit_zero')"""),
    Statement("agg17_table_quality", "Quality of tables, by dataset and over all.",
        f"""select coalesce(dataset_name, 'all') as dataset_name, count(*) as n, {rate("header_found")} as header_found, {rate("header_confirmed")} as header_confirmed, {rate("region_found")} as region_found, {rate("body_found")} as body_found, {rate("rows_found")} as rows_found,
 {rate("(count_pred > 0) = (count_true > 0)")} as presence, {rate("abs(count_pred - count_true) <= 1")} as within_one, round(avg(cast(abs(count_pred - count_true) as double)), 3) as mae, {shared("sum(count_validated)", "sum(count_pred)")} as validated_ratio from $runs group by grouping sets ((dataset_name), ())"""),
    Statement("agg20_dataset_quality", "Quality by dataset: statuses, readiness, accuracy of fields (a join of two aggregates).",
        f"""with q as (select dataset_name, {rate("ok")} as field_accuracy from (select dataset_name, {CORRECT} as ok from $fields) f group by dataset_name),
d as (select dataset_name, count(*) as documents, count(case when truth_status = 'supported' then 1 end) as with_truth, count(case when execution_status = 'completed' then 1 end) as completed, count(case when extraction_status = 'valid' then 1 end) as valid, count(case when extraction_status = 'needs_review' then 1 end) as needs_review,
 count(case when extraction_status = 'invalid' then 1 end) as invalid, count(case when erp_status = 'ready' then 1 end) as ready, count(case when extraction_status = 'invalid' and overall_confidence >= 0.85 then 1 end) as confident_invalid from $runs group by dataset_name)
select d.*, q.field_accuracy from d join q on q.dataset_name = d.dataset_name"""),
    Statement("agg21_validity", "Warnings and failures of a whole run.",
        """with a as (select count(*) as n, count(distinct document_id) as n_distinct, count(case when extraction_status = 'valid' then 1 end) as valid, count(case when erp_status = 'ready' then 1 end) as ready, count(case when truth_status = 'supported' then 1 end) as truths, count(case when currency_pred is not null then 1 end) as currencies,
 count(case when extraction_status = 'invalid' and overall_confidence >= 0.85 then 1 end) as confident_invalid, count(case when fresh_ocr then 1 end) as fresh, count(case when fresh_ocr and disk_hit then 1 end) as cached_fresh, max(seconds) as slowest from $runs)
select @codes(case when valid = 0 then 'NO_VALID_EXTRACTIONS' end, case when ready = 0 then 'NO_ERP_READY_DOCUMENTS' end, case when truths < greatest(5, n * 0.25) then 'GROUND_TRUTH_COVERAGE_LOW' end, case when confident_invalid >= n * 0.5 then 'HIGH_CONFIDENCE_INVALID_RATE_HIGH' end, case when currencies = 0 then 'CURRENCY_COMPLETENESS_ZERO' end, case when slowest > 30 then 'SLOWEST_OCR_TOO_HIGH' end) as warnings,
 @codes(case when n <> n_distinct then 'DUPLICATE_LATEST_DOCUMENT_SELECTION' end, case when cached_fresh > 0 then 'CACHED_ATTEMPT_MARKED_FRESH' end) as failures, n = n_distinct and fresh > 0 as valid_run from a"""),
    Statement("agg23_outcomes", "Metrics and error categories of a batch.",
        f"""with c as (select *, case when execution_status = 'timeout' then 'timeout' when execution_status <> 'completed' then 'error' when number_pred is null then 'missing_number' when ttc_pred is null then 'missing_total' when count_pred = 0 then 'no_rows' else 'ok' end as category from $runs)
select split_part(relative_path, '/', 1) as batch, category, count(*) as n, round(avg(cast(seconds as double)), 3) as mean_seconds, min_by(document_id, struct_of) as fastest, {rate("number_pred is null")} as missing_number from (select *, cast(seconds as double) + document_id * 1e-9 as struct_of from c) d group by 1, 2"""),
    Statement("agg24_datasets", "Summary by dataset and the hardest one.",
        f"""with d as (select dataset_name, count(*) as n, {rate("ttc_pred is not null")} as ttc_rate, {rate("number_pred is not null")} as number_rate from $runs group by dataset_name)
select d.*, row_number() over (order by ttc_rate, number_rate, dataset_name) = 1 as hardest from d"""),
    Statement("agg25_report", "Metrics of a report: missing rates, rows a document.",
        f"""select count(*) as n, {rate("supplier_pred is null")} as missing_supplier, {rate("customer_pred is null")} as missing_customer, {rate("number_pred is null")} as missing_number, {rate("date_pred is null")} as missing_date, {rate("ttc_pred is null")} as missing_ttc, round(avg(cast(count_pred as double)), 4) as mean_rows, {rate("abs(ht_pred + tva_pred - ttc_pred) <= 0.05")} as consistent from $runs"""),
    Statement("agg28_manual_summary", "Accuracy by field on applicable rows.",
        f"""select field, count(ok) as applicable, count(case when ok then 1 end) as correct, {rate("ok")} as accuracy, count(case when not ok and coalesce(predicted, '') = '' then 1 end) as missing, count(case when not ok then 1 end) as incorrect from (select *, {CORRECT} as ok from $fields) f group by field"""),
    Statement("agg28_composition", "Composition of a run by dataset and by type, as grouping sets.", "select dataset_name, document_type, count(*) as n from $runs group by grouping sets ((dataset_name), (document_type))"),
    Statement("agg30_hybrid", "Metrics of the hybrid run: rates, latency.",
        f"""select count(*) as n, {rate("hybrid_invoked")} as invocation_rate, {rate("not hybrid_invoked")} as bypass_rate, {shared("count(case when hybrid_invoked and parser_status = 'parsed' then 1 end)", "count(case when hybrid_invoked then 1 end)")} as valid_json_rate,
 round(avg(case when hybrid_invoked then cast(seconds as double) end), 4) as mean_seconds, cast(max(case when hybrid_invoked then seconds end) as double) as slowest from $runs where execution_status = 'completed'"""),
    Statement("agg31_truth_completeness", "Completeness of the ground truth, by document and over all.",
        f"""with d as (select document_id, @codes(case when supplier_true is null then 'supplier_name' end, case when customer_true is null then 'customer_name' end, case when number_true is null then 'invoice_number' end, case when date_true is null then 'invoice_date' end, case when count_true = 0 then 'line_items' end) as missing, document_id % 4 < 2 as verified,
 cast(supplier_true is not null as int) + cast(customer_true is not null as int) + cast(number_true is not null as int) + cast(date_true is not null as int) + cast(count_true > 0 as int) as present from $runs)
select count(*) as documents, count(case when verified and missing = '' then 1 end) as complete, {shared("sum(present)", "count(*) * 5")} as completeness, coalesce(bool_and(verified and missing = ''), false) as claim_allowed from d"""),
    Statement("agg32_before_after", "Accuracy before and after corrections, by field.",
        f"""with c as (select field, {norm("coalesce(deterministic, '')")} = {norm("truth")} as before_ok, case when accepted and proposed is not null then {norm("proposed")} = {norm("truth")} else {norm("coalesce(deterministic, '')")} = {norm("truth")} end as after_ok from $proposals where coalesce(truth, '') <> '')
select field, count(*) as n, {rate("before_ok")} as before_accuracy, {rate("after_ok")} as after_accuracy, count(case when after_ok and not before_ok then 1 end) as improved, count(case when before_ok and not after_ok then 1 end) as regressed from c group by field"""),
    Statement("agg33_return", "Return by category: frequency times weight, successes, failures, projected costs.",
        f"""with c as (select {CATEGORY} as category, {CLASS} as class, accepted from $proposals)
select category, count(*) as frequency, count(case when class = 'improvement' then 1 end) as succeeded, count(case when class in ('wrong', 'hallucination') then 1 end) as failed,
 count(*) * (case category when 'PARTY' then 5 when 'TABLES' then 5 when 'TOTALS' then 5 when 'METADATA' then 4 when 'OCR' then 2 else 1 end) + 3 * count(case when class = 'improvement' then 1 end) - 2 * count(case when class in ('wrong', 'hallucination') then 1 end) as score from c group by category"""),
    Statement("jon32_triggers", "Triggers with the corrections they led to.",
        f"""select trigger_reason as trigger_name, {CATEGORY} as category, count(*) as proposals, count(case when accepted then 1 end) as accepted, count(case when {CLASS} = 'improvement' then 1 end) as correct, count(case when {CLASS} in ('wrong', 'hallucination') then 1 end) as wrong, {shared(f"count(case when {CLASS} = 'improvement' then 1 end)", "count(*)")} as success_rate from $proposals group by trigger_reason"""),
    Statement("agg34_prompts", "Versions of the prompt compared.", f"select prompt_version, count(*) as n, {rate('accepted')} as accepted_rate, count(case when {CLASS} = 'improvement' then 1 end) as improvements, count(case when {CLASS} = 'hallucination' then 1 end) as hallucinations from $proposals group by prompt_version"),
    Statement("agg35_progress", "Progress of verification by dataset.",
        f"""with s as (select dataset_name, case document_id % 5 when 0 then 'verified' when 1 then 'verified' when 2 then 'needs_review' else 'draft' end as status, customer_true is null as no_customer, number_true is null as no_number from $runs)
select dataset_name, count(*) as n, {shared("100 * count(case when status = 'verified' then 1 end)", "count(*)")} as completion, count(case when status = 'draft' then 1 end) as draft, count(case when no_customer then 1 end) as missing_customer, count(case when no_number then 1 end) as missing_number from s group by dataset_name"""),
    Statement("agg37_acceptance", "Acceptance of an experiment: same quality, speed against the baseline.",
        """with b as (select dataset_name, cast(document_id % 2 as int) as variant, seconds, concat(extraction_status, erp_status) as signature from $runs),
m as (select dataset_name, variant, cast(count(*) as double) as n, round(avg(cast(seconds as double)), 4) as mean_seconds, count(distinct signature) as signatures from b group by dataset_name, variant)
select x.dataset_name, x.mean_seconds as baseline, y.mean_seconds as experiment, round(y.mean_seconds - x.mean_seconds, 4) as delta, y.signatures = x.signatures and y.mean_seconds < x.mean_seconds as accepted from m x join m y on x.dataset_name = y.dataset_name and x.variant = 0 and y.variant = 1"""),
    Statement("agg38_table_heavy", "Shares of documents with many rows.", f"select dataset_name, {rate('count_pred >= 4')} as table_heavy, {rate('count_pred >= 4 and count_validated = count_pred')} as heavy_validated, count(case when count_pred >= 4 and extraction_status = 'valid' then 1 end) as heavy_valid from $runs group by dataset_name"),
    Statement("jon24_latest_joined", "Latest rows with their manifest and label.",
        """with m as (select doc_id as document_id, currency from $manifest where doc_id % 6 <> 0), l as (select doc_id as document_id, count(*) as n_items from $items where doc_id % 4 <> 0 group by doc_id)
select r.document_id, r.extraction_status, m.document_id is not null as in_manifest, l.n_items, m.currency from $runs r left join m on m.document_id = r.document_id left join l on l.document_id = r.document_id"""),
    Statement("jon26_regressions", "Regressions between two runs of the same files, with reasons.",
        """with a as (select relative_path, extraction_status, count_pred, ttc_pred, erp_status from $runs), b as (select relative_path, case when document_id % 10 = 0 then 'invalid' else extraction_status end as extraction_status, case when document_id % 7 = 0 then count_pred - 1 else count_pred end as count_pred, case when document_id % 13 = 0 then null else ttc_pred end as ttc_pred, case when document_id % 9 = 0 then 'blocked' else erp_status end as erp_status from $runs)
select a.relative_path, @codes(case when a.extraction_status = 'valid' and b.extraction_status <> 'valid' then 'status' end, case when b.count_pred < a.count_pred then 'rows' end, case when a.ttc_pred is not null and b.ttc_pred is null then 'total' end, case when a.erp_status = 'ready' and b.erp_status <> 'ready' then 'readiness' end) as reasons from a join b on a.relative_path = b.relative_path"""),
    Statement("jon28_correction_index", "Corrections by document, prompt and field on the errors they concern.",
        f"""with e as (select document_id, field, 'v' as v from $fields where not coalesce({CORRECT}, true)), c as (select document_id, field, bool_or(accepted) as any_accepted, count(*) as n, min(prompt_version) as prompt_version from $proposals group by document_id, field)
select e.document_id, e.field, c.prompt_version, coalesce(c.any_accepted, false) as corrected, coalesce(c.n, 0) as n_proposals from e left join c on c.document_id = e.document_id and c.field = e.field"""),
    Statement("jon23_labels_of_images", "The label of each image: exact stem, normalised stem, suffix; the first rule that finds one.",
        f"""with i as (select document_id, split_part(split_part(relative_path, '/', 2), '.', 1) as stem from $runs), l as (select document_id as label_id, case document_id % 3 when 0 then concat('doc-', document_id) when 1 then concat('DOC_', document_id) else concat('scan of doc-', document_id) end as label_stem from $runs where document_id % 8 <> 0),
k as (select document_id, 1 as place, stem as k from i union all select document_id, 2, @rep(lower(stem), {rx('[^a-z0-9]+')}, '') from i union all select document_id, 3, stem from i),
m as (select label_id, 1 as place, label_stem as k from l union all select label_id, 2, @rep(lower(label_stem), {rx('[^a-z0-9]+')}, '') from l union all select label_id, 3, @rep(label_stem, {rx('^.* ')}, '') from l),
f as (select k.document_id, min(cast(k.place as bigint) * 1000000000 + m.label_id) as best from k join m on m.k = k.k and m.place = k.place group by k.document_id)
select i.document_id, cast(floor(best / 1000000000) as int) as rule, cast(best % 1000000000 as bigint) as label_id from i left join f on f.document_id = i.document_id"""),
    Statement("set02_pending_documents", "Selected but not completed, and failed ones to retry.", "select r.document_id, r.execution_status, r.execution_status in ('failed', 'timeout') as retry from $runs r where not exists (select 1 from $runs c where c.document_id = r.document_id and c.execution_status = 'completed')"),
    Statement("set04_token_relations", "Shared tokens of two names, subset and containment.",
        f"""with t as (select document_id, field, {norm("predicted")} as p, {norm("truth")} as t from $fields where kind = 'party' and predicted is not null and truth is not null), w as (select document_id, field, p, t, {norm("p")} = '' as e from t)
select document_id, field, contains(concat(' ', t, ' '), concat(' ', p, ' ')) as held, @cnt(@words(p), contains(concat(' ', t, ' '), concat(' ', w, ' '))) as n_shared, @cnt(@words(p), not contains(concat(' ', t, ' '), concat(' ', w, ' '))) as n_only_predicted from w"""),
    Statement("set08_restored_items", "Line items to restore that aren't there yet.", "select r.doc_id, r.row_index from $items r where r.row_index % 2 = 0 and not exists (select 1 from $items k where k.doc_id = r.doc_id and k.reference = r.reference and k.quantity = r.quantity and k.row_index % 2 = 1)"),
    Statement("srt01_worst_documents", "The 20 worst documents by missing and rejected values and status (a top-k report).",
        "select document_id, cast(cast(supplier_pred is null as int) + cast(customer_pred is null as int) + cast(number_pred is null as int) + cast(ttc_pred is null as int) + (count_pred - count_validated) + case when execution_status <> 'completed' then 99 when extraction_status = 'invalid' then 5 when extraction_status = 'needs_review' then 2 else 0 end as int) as badness from $runs order by badness desc, document_id limit 20"),
    Statement("srt03_top_counters", "Top counters of missing fields and datasets (a top-k report).", "select field, dataset_name, count(*) as n from $fields where predicted is null or predicted = '' group by field, dataset_name order by n desc, field, dataset_name limit 20"),
    Statement("smp02_dataset_sample", "Twelve documents of each dataset by hash, the rest filled up to 100 (a sampling operator).",
        """with h as (select document_id, dataset_name, @hash(concat('seed42|', document_id)) as h from $runs), p as (select *, row_number() over (partition by dataset_name order by h) as place from h), o as (select *, row_number() over (order by case when place <= 12 then 0 else 1 end, h) as position from p)
select document_id, dataset_name, place <= 12 as own_share from o where position <= 100"""),
    Statement("smp05_difficult", "Documents by difficulty (a top-k report).",
        "select document_id, cast(case when extraction_status = 'invalid' then 3 when extraction_status = 'needs_review' then 2 else 0 end + cast(supplier_pred is null as int) * 2 + cast(ttc_pred is null as int) * 2 + case when coalesce(overall_confidence, 0) < 0.5 then 2 else 0 end + case when count_pred <> count_true then 1 else 0 end as int) as difficulty from $runs order by difficulty desc, document_id limit 50"),
    Statement("prj03_expanded_fields", "Fields as rows with provenance, and fields found by pattern.",
        "select document_id, field, predicted as value, cast((document_id * 13 % 100) * 0.01 as double) as confidence, 'selected' as provenance, length(predicted) as n_chars from $fields where predicted is not null union all select document_id, 'due_year', concat('', substr(date_pred, 1, 4)), cast(0.62 as double), 'pattern', 4 from $runs where date_pred is not null"),
    Statement("prj07_overlay", "The validated export: fields of documents, null where rejected.",
        "select document_id, case when extraction_status <> 'invalid' then supplier_pred end as supplier, number_pred as number, case when abs(ht_pred + tva_pred - ttc_pred) <= greatest(0.05, abs(ttc_pred) * 0.002) then cast(ttc_pred as double) end as total, extraction_status <> 'valid' as review_required from $runs"),
    Statement("prj10_validation_report", "Report of a document's validation.", "select document_id, extraction_status as status, @codes(case when ttc_pred <= 0 then 'ttc_not_positive' end, case when abs(ht_pred + tva_pred - ttc_pred) > greatest(0.05, abs(ttc_pred) * 0.001) then 'mismatch' end) as errors, @codes(case when number_pred is null then 'reference' end, case when date_pred is null then 'date' end, case when currency_pred is null then 'currency' end) as warnings from $runs"),
    Statement("prj11_issues", "Issues for a reviewer, one row each.",
        """select document_id, 'party' as kind, 'supplier equals customer' as issue from $runs where lower(supplier_pred) = lower(customer_pred) union all select document_id, 'line_item', 'rows need review' from $runs where count_validated < count_pred
union all select document_id, 'financial', 'totals differ' from $runs where abs(ht_pred + tva_pred - ttc_pred) > 0.05 union all select document_id, 'missing', field from $fields where predicted is null"""),
    Statement("prj14_attempt_rows", "Rows of attempts: outcome, prediction and truth beside each other.", "select document_id, dataset_name, execution_status, case when execution_status = 'completed' then extraction_status else 'unavailable' end as extraction_status, case when execution_status = 'completed' then number_pred end as number_pred, case when truth_status = 'supported' then number_true end as number_true, seconds > 30 as over_budget from $runs"),
    Statement("prj16_vectors", "Vectors of predictions against labels.", f"select document_id, @codes(case when {norm('supplier_pred')} = {norm('supplier_true')} then 'supplier' end, case when {norm('number_pred')} = {norm('number_true')} then 'number' end, case when date_pred = date_true then 'date' end, case when currency_pred = currency_true then 'currency' end, case when abs(ttc_pred - ttc_true) <= 0.02 then 'ttc' end) as agreeing from $runs"),
    Statement("agg09_code_pairs", "Codes that occur together (a top-k report).",
        """with c as (select document_id, 'MISSING_SUPPLIER' as code from $runs where supplier_pred is null union all select document_id, 'MISSING_CUSTOMER' from $runs where customer_pred is null union all select document_id, 'NO_TABLE' from $runs where count_pred = 0 union all select document_id, 'INVALID' from $runs where extraction_status = 'invalid' union all select document_id, 'MISSING_TTC' from $runs where ttc_pred is null)
select a.code as first_code, b.code as second_code, count(*) as n from c a join c b on a.document_id = b.document_id and a.code < b.code group by a.code, b.code order by n desc, first_code, second_code limit 20"""),
    Statement("set05_distinct_codes", "Distinct triggers of each document, sorted.", "select document_id, count(distinct trigger_reason) as n, min(trigger_reason) as first_trigger, max(trigger_reason) as last_trigger from $proposals group by document_id"),
    Statement("run01_attempts", "Attempts numbered, back-filled and marked as fresh.",
        """with o as (select document_id, log_seq, execution_status, coalesce(nullif(extraction_status, 'unavailable'), case when execution_status = 'completed' then 'invalid' else 'unavailable' end) as extraction_status, disk_cache_hit, duration_seconds, row_number() over (partition by document_id order by log_seq) as attempt, lag(log_seq) over (partition by document_id order by log_seq) as previous, lag(execution_status) over (partition by document_id order by log_seq) as previous_status from $attempts)
select document_id, log_seq, attempt, previous, coalesce(previous_status, 'none') as previous_status, attempt > 1 as is_retry, not disk_cache_hit and execution_status = 'completed' and duration_seconds > 0 as fresh, extraction_status from o"""),
    Statement("agg11_percentiles", "Percentiles by the rounded index on sorted values, and by linear interpolation's two neighbours.",
        """with o as (select dataset_name, seconds, row_number() over (partition by dataset_name order by seconds, document_id) as place, count(*) over (partition by dataset_name) as n from $runs)
select dataset_name, cast(max(case when place = @even(0.5e0 * (n - 1)) + 1 then seconds end) as double) as median, cast(max(case when place = @even(0.9e0 * (n - 1)) + 1 then seconds end) as double) as p90, cast(max(case when place = floor(0.9e0 * (n - 1)) + 1 then seconds end) as double) as below, cast(max(case when place = ceil(0.9e0 * (n - 1)) + 1 then seconds end) as double) as above from o group by dataset_name"""),
    Statement("src13_discovery", "Documents of a listing: the top folder is the dataset, other suffixes drop out, in order.",
        f"select document_id, split_part(path, '/', 1) as dataset, path, row_number() over (partition by split_part(path, '/', 1) order by path, document_id) as place from (select document_id, concat(relative_path, case when document_id % 5 = 0 then '.bak' else '' end) as path from $runs) p where @m(lower(path), {rx('[.](?:pdf|png|jpg|jpeg|tif|tiff|bmp)$')})"),
    Statement("snk03_appended", "Corrections appended to a log: every accepted one once, in order.", "select document_id, field, proposed as corrected, row_number() over (partition by document_id order by field) as seq from $proposals where accepted and proposed is not null"),
]
