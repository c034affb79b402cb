"""Queries that show scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.dialect import duck
from .fixtures import VIEWS, load, with_views
from .registry import QUERIES, SQL

KEYS = {"lines": ("doc_id", "line_index"), "items_full": ("doc_id", "row_index"), "invoices": ("doc_id",), "runs": ("document_id",), "customer": ("c_custkey",), "part": ("p_partkey",), "orders": ("o_orderkey",)}


def show(name: str, about: str, source: str, sql: str, columns) -> None:
    """Register a query that shows ``columns()`` beside the key of ``source``;
    ``sql`` are the columns for DuckDB."""

    def run(spark, sf_dir):
        return load(spark, sf_dir, source).select(*KEYS[source], *[c.alias(n) for n, c in columns().items()])

    run.__name__, run.__doc__ = name, about
    QUERIES[name] = run
    head = with_views(source) + " " if source in VIEWS else ""
    SQL[name] = f"{head}select {', '.join(KEYS[source])}, {duck(sql)} from {source}"


show("str01_spacing", "Texts in compatibility composition with single blanks.", "lines", "trim(@rep(text, '[ \\t]+', ' ')) as spaced", lambda: dict(spaced=T.normalize_spacing(F.col("text"))))
show("str03_digits", "Arabic digits as ASCII ones.", "lines", "concat(text, ' 042') as digits", lambda: dict(digits=T.ascii_digits(F.concat(F.col("text"), F.lit(" ٠٤۲")))))
show("str04_first_match", "The first of several patterns that occurs.", "lines", "case when regexp_matches(text, '(?i)due date') then regexp_extract(text, '(?i)due date', 0) when regexp_matches(text, '(?i)total +([a-z]+)') then regexp_extract(text, '(?i)total +([a-z]+)', 1) end as found", lambda: dict(found=T.first_match(F.col("text"), "due date", "total +([a-z]+)")))
show("str05_table_norm", "Texts as a table's words are compared.", "lines", "trim(@rep(lower(strip_accents(text)), '[^0-9a-z.%\\x{0600}-\\x{06FF}]+', ' ')) as norm", lambda: dict(norm=T.table_norm(F.col("text"))))
show("str06_party_norm", "Names as parties are compared.", "lines", "trim(@rep(lower(strip_accents(text)), '[^0-9a-z\\x{0600}-\\x{06FF}]+', ' ')) as norm", lambda: dict(norm=T.party_norm(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")))))
show("str08_legal_forms", "Dotted legal forms joined before words are taken.", "customer", "trim(@rep(lower(c_name) || ' sarl llc', '[^\\p{L}\\p{N}]+', ' ')) as norm", lambda: dict(norm=T.without_dots(F.concat(F.col("c_name"), F.lit(" S.A.R.L L.L.C")))))
show("str10_repeats", "Adjacent equal words once.", "customer", "trim(@rep(lower(c_name), '[^\\p{L}\\p{N}]+', ' ')) || ' trading' as once", lambda: dict(once=T.without_repeats(F.concat(T.words_only(F.col("c_name")), F.lit(" trading trading")))))
show("str12_role_labels", "One leading label of a role stripped.", "customer", "lower(c_name) as bare", lambda: dict(bare=T.without_role_label(F.concat(F.lit("bill to "), F.lower(F.col("c_name"))))))
show("str13_descriptions", "Descriptions without row number and marks, of three letters or more.", "part", "case when length(@rep(p_name, '[^\\p{L}]', '')) >= 3 then trim(@rep(p_name, '\\s+', ' ')) end as description", lambda: dict(description=T.description(F.concat(F.lit("07. "), F.col("p_name"), F.lit(" |")))))
show("str15_placeholders", "Placeholders instead of values.", "runs", "coalesce(trim(@rep(lower(supplier_pred), '[^\\p{L}\\p{N}]+', ' ')) in ('todo', 'tbd', 'unknown', 'na', 'none', 'null', 'placeholder'), false) as is_placeholder", lambda: dict(is_placeholder=F.coalesce(T.is_placeholder(F.col("supplier_pred")), F.lit(False))))
show("str16_label_keys", "Keys of labels.", "lines", "@rep(@rep(lower(text), '[^a-z0-9]+', '_'), '^_+|_+$', '') as label_key", lambda: dict(label_key=T.label_key(F.col("text"))))
show("str17_markup", "Texts without token markup.", "lines", "trim(@rep(text, '\\s+', ' ')) as bare", lambda: dict(bare=T.without_markup(F.concat(F.lit("<s_menu> "), F.col("text"), F.lit(" </s_menu>")))))
show("str18_compact", "Texts cut to a length.", "lines", "substr(trim(@rep(text, '\\s+', ' ')), 1, 12) as cut", lambda: dict(cut=T.compact(F.col("text"), 12)))
show("str19_iban", "Account numbers: upper case letters and digits.", "lines", "@rep(upper(text), '[^A-Z0-9]', '') as iban", lambda: dict(iban=T.iban(F.col("text"))))
show("str20_letters_for_digits", "Letters read for digits.", "invoices", "replace(invoice_number, 'x', '') as fixed", lambda: dict(fixed=F.replace(T.letter_digit_fixed(F.regexp_replace("invoice_number", "0([0-9])", "O$1")), F.lit("x"), F.lit(""))))
show("num02_benchmark_amounts", "Amounts of labels in three notations.", "items_full", "cast(line_total_ht as double) as plain, cast(line_total_ht as double) as comma, cast(line_total_ht as double) as both", lambda: dict(plain=N.benchmark_amount(F.col("line_total_ht").cast("string")), comma=N.benchmark_amount(F.replace(F.col("line_total_ht").cast("string"), F.lit("."), F.lit(","))), both=N.benchmark_amount(F.concat(F.format_number(F.col("line_total_ht"), 3), F.lit(" EUR")))))
show("num03_last_numbers", "The last number of a text; parentheses make it negative.", "items_full", "cast(line_total_ht as double) as last, -cast(line_total_ht as double) as negative", lambda: dict(last=N.last_number(F.concat(F.lit("3 x "), F.col("line_total_ht").cast("string"))).cast("double"), negative=N.last_number(F.concat(F.lit("("), F.col("line_total_ht").cast("string"), F.lit(")"))).cast("double")))
show("num04_cell_numbers", "The last money token of a cell.", "items_full", "cast(line_total_ht as double) as value", lambda: dict(value=N.cell_number(F.concat(F.lit("12 pcs "), F.col("line_total_ht").cast("string"))).cast("double")))
show("num05_money", "The first number unless the text is words.", "items_full", "cast(line_total_ht as double) as value, cast(null as double) as none", lambda: dict(value=N.money_or_number(F.concat(F.lit("$"), F.col("line_total_ht").cast("string"))).cast("double"), none=N.money_or_number(F.lit("lot 7 of goods")).cast("double")))
show("num06_floats", "Numbers with blanks and a comma.", "items_full", "cast(line_total_ht as double) as value", lambda: dict(value=N.float_or_none(F.concat(F.lit(" "), F.replace(F.col("line_total_ht").cast("string"), F.lit("."), F.lit(",")), F.lit(" ")))))
show("num07_confidence", "Confidence within 0 and 1 at three digits.", "runs", "case when overall_confidence is not null then cast(least(1, greatest(0, overall_confidence * 2 - 0.3)) as double) end as confidence", lambda: dict(confidence=N.confidence(F.col("overall_confidence") * 2 - F.lit(0.3)).cast("double")))
show("num08_equal_amounts", "Amounts that are equal within a tolerance.", "runs", "abs(ttc_pred - ttc_true) <= 0.02 or abs(ttc_pred - ttc_true) <= abs(ttc_true) * 0.005 as equal", lambda: dict(equal=N.amounts_equal(F.col("ttc_pred"), F.col("ttc_true"))))
show("num10_truthy", "Texts that say yes.", "runs", "coalesce(lower(trim(parser_status)) in ('1', 'true', 'yes', 'on'), false) as flag, fresh_ocr as same", lambda: dict(flag=N.truthy(F.col("parser_status")), same=N.truthy(F.col("fresh_ocr"))))
show("sim04_numbers", "Numbers that match.", "runs", "cast(abs(cast(ttc_pred as double) - cast(ttc_true as double)) <= greatest(0.01e0, abs(cast(ttc_true as double)) * 0.005e0) as int) as matched", lambda: dict(matched=N.numbers_match(F.col("ttc_pred").cast("double"), F.col("ttc_true").cast("double"))))
DMY = "strftime(cast(o_orderdate as date), '%d/%m/%Y')"
show("dat02_context_dates", "Dates beside an English and a French label.", "orders", "cast(cast(o_orderdate as date) as varchar) as english, cast(cast(o_orderdate as date) as varchar) as french", lambda: dict(english=F.when(F.dayofmonth(F.col("o_orderdate").cast("date")) <= 12, N.in_context(F.date_format(F.col("o_orderdate").cast("date"), "MM/dd/yyyy"), F.lit("Invoice Date"))).otherwise(F.col("o_orderdate").cast("date")).cast("string"), french=N.in_context(F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy"), F.lit("Date facture")).cast("string")))
show("dat03_readings", "The readings of a date and whether it is ambiguous.", "orders", "cast(case when day(o_orderdate) <= 12 and day(o_orderdate) <> month(o_orderdate) then 2 else 1 end as int) as n_readings, day(o_orderdate) <= 12 and day(o_orderdate) <> month(o_orderdate) as ambiguous", lambda: dict(n_readings=F.size(N.possible_dates(F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy"))), ambiguous=F.size(N.possible_dates(F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy"))) > 1))
show("dat04_month_first", "Dates month first, else day first.", "orders", f"cast(case when day(o_orderdate) <= 12 then strptime({DMY}, '%m/%d/%Y') else o_orderdate end as date)::varchar as d", lambda: dict(d=N.month_first(F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy")).cast("string")))
show("hsh02_fingerprints", "Fingerprints of a configuration with sorted keys.", "runs", "sha256(concat('{\"dataset\":\"', dataset_name, '\",\"status\":\"', extraction_status, '\"}')) as fingerprint", lambda: dict(fingerprint=F.sha2(F.to_json(F.struct(F.col("dataset_name").alias("dataset"), F.col("extraction_status").alias("status"))), 256)))
show("jsn01_coerced", "Texts coerced to JSON, literals with other quotes too.", "customer", "c_name as json_name, c_name as literal_name", lambda: dict(json_name=F.get_json_object(F.to_json(F.struct(F.col("c_name").alias("name"))), "$.name"), literal_name=F.get_json_object(F.translate(F.concat(F.lit("{'name': '"), F.col("c_name"), F.lit("'}")), "'", '"'), "$.name")))
show("jsn02_lists", "Lists from JSON and from parts between semicolons.", "customer", "cast(2 as int) as n_json, c_mktsegment as second", lambda: dict(n_json=F.size(T.listed(F.to_json(F.array("c_name", "c_mktsegment")))), second=F.get(T.listed(F.concat_ws("; ", "c_name", "c_mktsegment")), F.lit(1))))
show("img03_resize", "Scale of a page: longest side at most 1600, else width at least 900.", "lines", "case when greatest(page_width, page_height) > 1000 then round(1000.0e0 / greatest(page_width, page_height), 6) when page_width < 900 then round(900.0e0 / page_width, 6) else 1.0e0 end as scale", lambda: dict(scale=F.when(F.greatest("page_width", "page_height") > 1000, F.round(F.lit(1000.0) / F.greatest("page_width", "page_height"), 6)).when(F.col("page_width") < 900, F.round(F.lit(900.0) / F.col("page_width"), 6)).otherwise(1.0)))
show("img04_deskew", "Angles to correct: of at least 0.3 and at most 15 degrees.", "lines", "case when abs((line_index - 15) * 1.5e0) between 0.3e0 and 15 then (line_index - 15) * 1.5e0 else 0.0e0 end as angle", lambda: dict(angle=F.when(F.abs((F.col("line_index") - 15) * 1.5).between(0.3, 15), (F.col("line_index") - 15) * 1.5).otherwise(0.0)))
