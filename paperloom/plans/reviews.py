"""Queries over matching, corrections and the proposal gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import review as R
from .fixtures import load, with_views
from .registry import query


@query("select c_custkey, case when c_custkey % 4 = 0 then 'exact' when c_custkey % 4 in (1, 2) then 'canonical_exact' else 'unavailable' end as match_class from customer")
def pty07_compare(spark, sf_dir):
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    truth = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit(" LLC"))).when(k == 2, F.concat(name, F.lit(" Ltd. Inc.")))
    rows = load(spark, sf_dir, "customer").select("c_custkey", name.alias("predicted"), truth.alias("truth"))
    return M.compare_names(rows).select("c_custkey", "match_class")


@query()
def jon22_match_all_items(spark, sf_dir):
    """Every item, nulls included, against a truth in another order that lacks
    some items, has some that the prediction lacks, and differs in texts and
    quantities; unmatched items of both sides stay. Greedy matching has no
    affordable SQL; tests hold it against brute force."""
    rows = load(spark, sf_dir, "line_items")
    at = F.col("doc_id") + F.col("row_index")
    predicted = rows.where("(doc_id + row_index) % 7 <> 0")
    truth = rows.where("(doc_id + row_index) % 5 <> 0").withColumns(
        {
            "row_index": 100 - F.col("row_index"),
            "description": F.when(at % 3 == 0, F.concat(F.lit("Lot "), F.upper("description"))).otherwise(F.col("description")),
            "reference": F.when(at % 4 == 0, F.lit(None)).otherwise(F.col("reference")),
            "quantity": F.when(at % 6 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")),
        }
    )
    return M.match_items(predicted, truth)


@query(with_views("ocr_lines") + "select doc_id, cast(line_index//5 as bigint) as row, count(*) as n from ocr_lines group by 1, 2")
def win02_physical_rows(spark, sf_dir):
    """Running-mean rows; lines of a table row share one."""
    lines = load(spark, sf_dir, "ocr_lines")
    rows = M.physical_rows(lines).withColumn("own", F.floor(F.col("line_index") / 5))
    first = rows.groupBy("doc_id", "row").agg(F.min("own").alias("own"), F.count("*").alias("n"))
    return first.select("doc_id", F.col("own").cast("long").alias("row"), "n")


@query(with_views("ocr_lines") + "select doc_id, count(distinct col_name) as n_columns from ocr_lines group by doc_id")
def win05_clusters(spark, sf_dir):
    rows = load(spark, sf_dir, "ocr_lines").groupBy("doc_id").agg(F.collect_list(((F.col("x1") + F.col("x2")) / 2).cast("double")).alias("xs"))
    return rows.select("doc_id", F.size(M.centre_clusters(F.col("xs"))).cast("long").alias("n_columns"))


FIELDS = with_views("invoices") + ", fields as (select doc_id, 'currency' as field, currency as value from invoices), log as (select user_id as doc_id, 'currency' as field, event_type as corrected, case when event_id % 3 = 0 then 'rejected' when event_id % 3 = 1 then 'accepted' else 'edited' end as action, event_id as seq, concat('t', user_id % 7) as tenant_id from events) "


def _log(spark, sf_dir):
    action = F.when(F.col("event_id") % 3 == 0, "rejected").when(F.col("event_id") % 3 == 1, "accepted").otherwise("edited")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit("currency").alias("field"), F.col("event_type").alias("corrected"), action.alias("action"), F.col("event_id").alias("seq"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant_id"))


@query(FIELDS + ", l as (select doc_id, field, arg_max(corrected, seq) as corrected from log where action <> 'rejected' group by doc_id, field) select doc_id, field, coalesce(corrected, value) as value, corrected is not null as was_corrected from fields left join l using (doc_id, field)")
def cor02_corrections(spark, sf_dir):
    fields = load(spark, sf_dir, "invoices").select("doc_id", F.lit("currency").alias("field"), F.col("currency").alias("value"))
    return R.apply_corrections(fields, _log(spark, sf_dir))


@query(FIELDS + "select tenant_id, field, corrected, n, first_seq, cast(place as integer) as place from (select *, row_number() over (partition by tenant_id, field order by n desc, first_seq, corrected) as place from (select tenant_id, field, corrected, count(*) as n, min(seq) as first_seq from log group by all)) where place <= 50")
def agg08_memory(spark, sf_dir):
    return R.memory(_log(spark, sf_dir))


@query(with_views("line_items") + "select doc_id, row_index from line_items where (doc_id + row_index) % 5 <> 0")
def jon30_ignored_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "line_items")
    return R.without_ignored(rows, rows.where("(doc_id + row_index) % 5 = 0").select("doc_id", "row_index")).select("doc_id", "row_index")


@query(
    with_views("invoices")
    + """select doc_id, amount_ttc is not null and doc_id % 3 <> 0 and doc_id % 5 <> 0 and doc_id % 11 <> 0 and 85 + doc_id % 15 >= 90 as accepted from invoices where amount_ttc is not null"""
)
def llm06_gate(spark, sf_dir):
    """Proposals for totals: some with unknown references, some whose value the
    evidence lacks, some with a stale old value, some below the confidence."""
    rows = load(spark, sf_dir, "invoices").where("amount_ttc is not null")
    value = F.col("amount_ttc").cast("string")
    fields = rows.select("doc_id", F.lit("amount_ttc").alias("field"), value.alias("value"))
    evidence = rows.select("doc_id", F.lit("L1").alias("ref"), F.concat(F.lit("Total TTC: "), F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise(value)).alias("text"))
    proposals = rows.select("doc_id", F.lit("amount_ttc").alias("field"), F.when(F.col("doc_id") % 11 == 0, "stale").otherwise(value).alias("old_value"), value.alias("proposed_value"), ((F.col("doc_id") % 15 + 85) / 100).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("L1"), F.lit("L9"))).otherwise(F.array(F.lit("L1"))).alias("refs"))
    return R.gate(proposals, evidence, fields).select("doc_id", "accepted")


@query("with m as (select conv_id as doc_id, row_number() over (partition by conv_id order by turn, role, text) as line_index, text from conversations), n as (select *, max(case when length(text) > 200 then 1 else 0 end) over (partition by doc_id order by line_index rows between 1 preceding and 1 following) as near from m), c as (select *, sum(length(text)) over (partition by doc_id order by line_index) as chars, row_number() over (partition by doc_id order by line_index) as pos from n where near = 1) select doc_id, cast(line_index as integer) as line_index, cast(chars as bigint) as chars from c where chars <= 1500 or pos = 1")
def llm02_evidence(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.row_number().over(order).alias("line_index"), "text")
    return R.evidence_lines(lines, F.length("text") > 200, 1500).select("doc_id", "line_index", "chars")


def _name_pairs(spark, sf_dir):
    name, k = F.col("c_name"), F.col("c_custkey") % 4
    other = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit(" Trading"))).when(k == 2, F.reverse(name))
    return load(spark, sf_dir, "customer").select("c_custkey", F.lower(name).alias("predicted"), F.lower(other).alias("truth"))


@query()
def sim01_ratios(spark, sf_dir):
    """Token-set, token-sort and character ratios of names; matching blocks
    have no SQL, tests hold them against the standard library."""
    return M.ratios(_name_pairs(spark, sf_dir), "predicted", "truth")


@query("select c_custkey, c_custkey % 4 = 0 as similar from customer where c_custkey % 4 in (0, 3)")
def sim02_similar_names(spark, sf_dir):
    """Names whose character ratio is 85 or more (equal ones and missing ones,
    for which the answer is known)."""
    rows = M.ratios(_name_pairs(spark, sf_dir), "predicted", "truth").where("c_custkey % 4 in (0, 3)")
    return rows.select("c_custkey", (F.col("characters") >= 85).alias("similar"))


@query()
def jon21_scored_items(spark, sf_dir):
    """Predicted against true line items at 0.45, one to one by greatest score;
    greedy matching has no affordable SQL, tests hold it against brute force."""
    rows = load(spark, sf_dir, "line_items")
    truth = rows.where("(doc_id + row_index) % 5 <> 0").withColumn("row_index", 100 - F.col("row_index"))
    return M.match_items(rows, truth, least=0.45)
