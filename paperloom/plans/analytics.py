"""Queries over attempts and labels, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .fixtures import load, with_views
from .registry import query

A = with_views("attempts")
LATEST = A + ", latest as (select * from (select *, row_number() over (partition by document_id order by log_seq desc) as pos from attempts) where pos = 1) "


def _attempts(spark, sf_dir):
    return load(spark, sf_dir, "attempts")


@query(A + "select document_id, log_seq, cast(row_number() over w as integer) as attempt_number, lag(log_seq) over w as previous_seq, lag(execution_status) over w as previous_status, row_number() over w > 1 as is_retry from attempts window w as (partition by document_id order by log_seq)")
def win13_attempt_number(spark, sf_dir):
    return E.attempt_history(_attempts(spark, sf_dir)).select("document_id", "log_seq", "attempt_number", "previous_seq", "previous_status", "is_retry")


@query(LATEST + "select document_id, log_seq, execution_status, extraction_status, cast(duration_seconds as double) as duration_seconds from latest")
def win14_latest_attempt(spark, sf_dir):
    return E.latest_attempts(_attempts(spark, sf_dir)).select("document_id", "log_seq", "execution_status", "extraction_status", F.col("duration_seconds").cast("double").alias("duration_seconds"))


@query(A + "select distinct document_id from attempts where execution_status in ('failed', 'timeout')")
def set02_retry(spark, sf_dir):
    rows = _attempts(spark, sf_dir)
    return rows.where(F.col("execution_status").isin("failed", "timeout")).select("document_id").distinct()


PERF = """
, p as (
 select 'all' as population, duration_seconds as d from attempts union all select 'fresh', duration_seconds from attempts where not disk_cache_hit
 union all select 'cached', duration_seconds from attempts where disk_cache_hit union all select 'completed', duration_seconds from attempts where execution_status = 'completed'),
r as (select population, d, row_number() over (partition by population order by d) - 1 as i, count(*) over (partition by population) as n from p where d is not null)
select population, max(n) as n, cast(sum(d) as double)/max(n) as mean,
 cast(max(case when i = (n-1)//2 then d end) + max(case when i = n//2 then d end) as double)/2 as median,
 cast(max(case when i = cast(round_even(0.9e0*(n-1), 0) as bigint) then d end) as double) as p90,
 cast(max(case when i = cast(round_even(0.95e0*(n-1), 0) as bigint) then d end) as double) as p95,
 cast(max(d) as double) as max, cast(count(*) filter (d <= 30) as bigint) as within_30 from r group by population
"""


@query(A + PERF)
def agg10_performance(spark, sf_dir):
    return E.performance(_attempts(spark, sf_dir), {"all": F.lit(True), "fresh": ~F.col("disk_cache_hit"), "cached": F.col("disk_cache_hit"), "completed": F.col("execution_status") == "completed"})


@query(A + "select dataset_name, quantile_cont(cast(duration_seconds as double), 0.5) as p50, quantile_cont(cast(duration_seconds as double), 0.9) as p90, stddev_samp(cast(duration_seconds as double)) as sd from attempts group by dataset_name")
def agg27_interpolated(spark, sf_dir):
    d = F.col("duration_seconds").cast("double")
    return _attempts(spark, sf_dir).groupBy("dataset_name").agg(F.percentile(d, 0.5).alias("p50"), F.percentile(d, 0.9).alias("p90"), F.stddev_samp(d).alias("sd"))


@query(
    A + """select dataset_name, count(*) as n, count(distinct document_id) as documents, count(*) filter (execution_status='completed') as completed, count(*) filter (execution_status='failed') as failed,
    count(*) filter (execution_status='timeout') as timeout, count(*) filter (extraction_status='valid') as valid, count(*) filter (extraction_status='needs_review') as needs_review,
    count(*) filter (extraction_status='invalid') as invalid from attempts group by grouping sets ((dataset_name), ())"""
)
def agg18_run_summary(spark, sf_dir):
    rows = _attempts(spark, sf_dir)
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return rows.rollup("dataset_name").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"), *[count("execution_status", v) for v in ("completed", "failed", "timeout")], *[count("extraction_status", v) for v in ("valid", "needs_review", "invalid")])


@query(with_views("invoices") + "select field, count(v) as n_present, round(100.0e0*count(v)/count(*), 2) as percent from (select unnest(['invoice_number','customer_name','currency','amount_ttc']) as field, unnest([invoice_number, customer_name, currency, cast(amount_ttc as varchar)]) as v from invoices) group by field")
def agg19_completeness(spark, sf_dir):
    rows = load(spark, sf_dir, "invoices")
    names = ("invoice_number", "customer_name", "currency", "amount_ttc")
    one = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_present"), F.round(F.col(c) * 100.0 / F.col("n"), 2).alias("percent")) for c in names])))


@query(LATEST + "select dataset_name, count(*) as documents, round(avg(case when extraction_status='valid' then 1 else 0 end), 4) as valid_rate, round(avg(case when extraction_status='unavailable' then null when extraction_status='valid' then 1 else 0 end), 4) as valid_of_known from latest group by dataset_name")
def agg20_dataset_quality(spark, sf_dir):
    rows = E.latest_attempts(_attempts(spark, sf_dir))
    valid = F.col("extraction_status") == "valid"
    return rows.groupBy("dataset_name").agg(F.count("*").alias("documents"), E.rate(valid).alias("valid_rate"), E.rate(F.when(F.col("extraction_status") != "unavailable", valid)).alias("valid_of_known"))


@query(A + "select count(*) as n, cast(sum(duration_seconds) as double)/count(*) as mean_seconds, cast(sum(duration_seconds) as double)/count(*)*8000/3600 as hours_8000, round(avg(case when disk_cache_hit then 1 else 0 end), 4) as cache_rate from attempts")
def agg22_projection(spark, sf_dir):
    mean = F.sum("duration_seconds").cast("double") / F.count("*")
    return _attempts(spark, sf_dir).agg(F.count("*").alias("n"), mean.alias("mean_seconds"), (mean * 8000 / 3600).alias("hours_8000"), E.rate(F.col("disk_cache_hit")).alias("cache_rate"))


@query("select event_type as stage, count(*) as n, cast(sum(cast(value as decimal(12,2))) as double) as total, cast(sum(cast(value as decimal(12,2))) as double)/count(*) as mean, cast(max(cast(value as decimal(12,2))) as double) as max from events group by event_type")
def agg26_stage_timing(spark, sf_dir):
    return E.stage_timing(load(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").cast("decimal(12,2)").alias("seconds")))


@query(A + "select execution_status, extraction_status, count(*) as n from attempts group by execution_status, extraction_status")
def agg39_distribution(spark, sf_dir):
    return _attempts(spark, sf_dir).groupBy("execution_status", "extraction_status").agg(F.count("*").alias("n"))


CODES = """
, coded as (select document_id, log_seq, dataset_name, list_filter([case when execution_status = 'failed' then 'EXECUTION_FAILED' end, case when execution_status = 'timeout' then 'EXECUTION_TIMEOUT' end,
 case when extraction_status = 'invalid' then 'VALIDATION_INVALID' end, case when extraction_status = 'needs_review' then 'NEEDS_REVIEW' end, case when duration_seconds > 30 then 'SLOW_DOCUMENT' end,
 case when not disk_cache_hit then 'FRESH_RUN' end], lambda x: x is not null) as codes from attempts)
"""


def _coded(spark, sf_dir):
    rows = _attempts(spark, sf_dir)
    tests = {"EXECUTION_FAILED": F.col("execution_status") == "failed", "EXECUTION_TIMEOUT": F.col("execution_status") == "timeout", "VALIDATION_INVALID": F.col("extraction_status") == "invalid", "NEEDS_REVIEW": F.col("extraction_status") == "needs_review", "SLOW_DOCUMENT": F.col("duration_seconds") > 30, "FRESH_RUN": ~F.col("disk_cache_hit")}
    return rows.withColumn("codes", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()])))


@query(A + CODES + "select dataset_name, code, count(*) as n from (select dataset_name, unnest(codes) as code from coded) group by dataset_name, code")
def agg09_codes_by_dataset(spark, sf_dir):
    return _coded(spark, sf_dir).select("dataset_name", F.explode("codes").alias("code")).groupBy("dataset_name", "code").agg(F.count("*").alias("n"))


@query(LATEST + "select document_id, case execution_status when 'completed' then 0 else 99 end + case extraction_status when 'invalid' then 5 when 'needs_review' then 2 else 0 end as badness from latest order by badness desc, document_id limit 20")
def srt01_worst(spark, sf_dir):
    rows = E.latest_attempts(_attempts(spark, sf_dir))
    badness = F.when(F.col("execution_status") == "completed", 0).otherwise(99) + F.when(F.col("extraction_status") == "invalid", 5).when(F.col("extraction_status") == "needs_review", 2).otherwise(0)
    return rows.select("document_id", badness.alias("badness")).orderBy(F.desc("badness"), "document_id").limit(20)


@query(A + "select document_id, log_seq, cast(duration_seconds as double) as duration_seconds from attempts order by attempts.duration_seconds desc, log_seq limit 20")
def srt02_slowest(spark, sf_dir):
    rows = _attempts(spark, sf_dir).orderBy(F.desc("duration_seconds"), "log_seq").limit(20)
    return rows.select("document_id", "log_seq", F.col("duration_seconds").cast("double").alias("duration_seconds"))


@query(LATEST + "select dataset_name, document_id, cast(sample_rank as integer) as sample_rank from (select *, row_number() over (partition by dataset_name order by (document_id*7919+42) % 10007, document_id) as sample_rank from latest) where sample_rank <= 6")
def smp01_balanced(spark, sf_dir):
    rows = E.latest_attempts(_attempts(spark, sf_dir))
    key = F.struct((F.col("document_id") * 7919 + 42) % 10007, F.col("document_id"))
    return E.balanced_sample(rows, "dataset_name", key, 6).select("dataset_name", "document_id", "sample_rank")


@query(LATEST + "select dataset_name, extraction_status, document_id from (select *, row_number() over (partition by dataset_name, extraction_status order by (document_id*7919+42) % 10007, document_id) as r from latest) where r <= 5")
def smp04_stratified(spark, sf_dir):
    rows = E.latest_attempts(_attempts(spark, sf_dir)).withColumn("stratum", F.concat_ws("|", "dataset_name", "extraction_status"))
    key = F.struct((F.col("document_id") * 7919 + 42) % 10007, F.col("document_id"))
    return E.balanced_sample(rows, "stratum", key, 5).select("dataset_name", "extraction_status", "document_id")


TWO = """
, one as (select * from (select *, row_number() over (partition by document_id order by log_seq desc) as pos from attempts where log_seq % 2 = 0) where pos = 1),
two as (select * from (select *, row_number() over (partition by document_id order by log_seq desc) as pos from attempts where log_seq % 2 = 1) where pos = 1)
select one.document_id, case when one.extraction_status = 'unavailable' or two.extraction_status = 'unavailable' then 'not_evaluated'
 when one.extraction_status = two.extraction_status then 'tie' when one.extraction_status = 'valid' or two.extraction_status = 'invalid' then 'first' else 'second' end as better
from one join two using (document_id)
"""


@query(A + TWO)
def jon25_two_runs(spark, sf_dir):
    rows = _attempts(spark, sf_dir)
    one = E.latest_attempts(rows.where("log_seq % 2 = 0")).select("document_id", F.col("extraction_status").alias("x"))
    two = E.latest_attempts(rows.where("log_seq % 2 = 1")).select("document_id", F.col("extraction_status").alias("y"))
    better = F.when((F.col("x") == "unavailable") | (F.col("y") == "unavailable"), "not_evaluated").when(F.col("x") == F.col("y"), "tie").when((F.col("x") == "valid") | (F.col("y") == "invalid"), "first").otherwise("second")
    return one.join(two, "document_id").select("document_id", better.alias("better"))


SWEEP = """
with s as (select cast(doc_id*7919 % 100 as double)/100 as score, quality = 1 as label from labels join documents using (doc_id)),
t as (select unnest([0.5e0,0.55e0,0.6e0,0.65e0,0.7e0,0.75e0,0.8e0,0.85e0,0.9e0,0.95e0]) as threshold),
c as (select threshold, count(*) filter (label and score >= threshold) as tp, count(*) filter (not label and score >= threshold) as fp, count(*) filter (label and score < threshold) as fn from s, t group by threshold)
select threshold, tp, fp, fn, case when tp+fp > 0 then tp/(cast(tp as double)+fp) end as precision, case when tp+fn > 0 then tp/(cast(tp as double)+fn) end as recall, case when tp+fp+fn > 0 then 2*cast(tp as double)/(2*cast(tp as double)+fp+fn) end as f1 from c
"""


@query(SWEEP)
def agg29_calibration(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    rows = rows.select(((F.col("doc_id") * 7919 % 100).cast("double") / 100).alias("score"), (F.col("quality") == 1).alias("label"))
    return E.threshold_sweep(rows, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])


@query(LATEST + "select dataset_name, document_id, log_seq from (select *, row_number() over (partition by dataset_name order by document_id) as r from latest) where r <= 10")
def win22_capped(spark, sf_dir):
    return E.balanced_sample(E.latest_attempts(_attempts(spark, sf_dir)), "dataset_name", F.col("document_id"), 10).select("dataset_name", "document_id", "log_seq")


@query("select user_id as document_id, cast(count(*) filter (event_type='view') as bigint) as view, cast(count(*) filter (event_type='click') as bigint) as click, cast(count(*) filter (event_type='error') as bigint) as error from events group by user_id")
def snk11_wide(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("document_id")).pivot("event_type", ["view", "click", "error"]).count()
    return rows.na.fill(0)


@query(A + "select execution_status, cast(floor(duration_seconds/20) as integer) as bin, count(*) as n from attempts group by 1, 2")
def snk09_histogram(spark, sf_dir):
    return _attempts(spark, sf_dir).groupBy("execution_status", F.floor(F.col("duration_seconds") / 20).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(A + "select document_id, count(*) as attempts, max(log_seq) as last_seq, bool_or(execution_status='completed') as ever_completed, cast(min(duration_seconds) as double) as fastest from attempts group by document_id having count(*) >= 2")
def run01_normalized(spark, sf_dir):
    rows = _attempts(spark, sf_dir)
    return rows.groupBy("document_id").agg(F.count("*").alias("attempts"), F.max("log_seq").alias("last_seq"), F.bool_or(F.col("execution_status") == "completed").alias("ever_completed"), F.min("duration_seconds").cast("double").alias("fastest")).where("attempts >= 2")


@query(with_views("attempts") + "select document_id, log_seq, cast(sum(duration_seconds) over (partition by document_id order by log_seq) as double) as running from attempts where true qualify sum(duration_seconds) over (partition by document_id order by log_seq) - duration_seconds <= 200")
def win19_budget(spark, sf_dir):
    """Attempts until a budget is passed; the one that passes it is kept."""
    own = Window.partitionBy("document_id").orderBy("log_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = _attempts(spark, sf_dir).withColumn("s", F.sum("duration_seconds").over(own))
    return rows.where(F.col("s") - F.col("duration_seconds") <= 200).select("document_id", "log_seq", F.col("s").cast("double").alias("running"))
