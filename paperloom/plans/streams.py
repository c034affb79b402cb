"""Streaming queries, each with the SQL of its batch counterpart, and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import records as R
from ..sources.shared import shared_dir
from ..streaming import attempts as ST
from .fixtures import VIEWS, load, with_views
from .registry import query

A = with_views("attempts")


def _stream(spark, sf_dir):
    """The attempts as a stream of the events file."""
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").option("recursiveFileLookup", "true").parquet(sf_dir)
    return spark.sql(VIEWS["attempts"], events=events).withColumn("started_at", F.col("started_at").cast("timestamp"))


def _run(spark, df, mode):
    return ST.run_once(df, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", mode)


@query(A + "select document_id, max(log_seq) as log_seq, arg_max(execution_status, log_seq) as execution_status, count(*) as attempts from attempts group by document_id")
def stm1_latest_state(spark, sf_dir):
    return _run(spark, ST.latest_state(_stream(spark, sf_dir)), "complete")


@query(A + "select strftime(date_trunc('day', started_at), '%Y-%m-%d') as day, execution_status, count(*) as n from attempts group by 1, 2")
def stm2_failure_rates(spark, sf_dir):
    return _run(spark, ST.failure_rates(_stream(spark, sf_dir)), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "execution_status", "n")


@query(A + ", s as (select *, case when started_at - lag(started_at) over w >= interval 30 minute or lag(started_at) over w is null then 1 else 0 end as fresh from attempts window w as (partition by document_id order by started_at, log_seq)), g as (select *, sum(fresh) over (partition by document_id order by started_at, log_seq) as session from s) select document_id, n, count(*) as sessions from (select document_id, session, count(*) as n from g group by 1, 2) group by 1, 2")
def stm3_sessions(spark, sf_dir):
    rows = _run(spark, ST.sessions(_stream(spark, sf_dir)), "complete")
    return rows.groupBy("document_id", "n").agg(F.count("*").alias("sessions"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 'train' when o_orderkey % 4 = 1 then 'test' when o_orderkey % 4 = 2 then 'validation' else 'unknown' end as split from orders")
def src14_split(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    path = F.concat(F.lit("data/"), F.when(k == 0, "Train/").when(k == 1, "test/").when(k == 2, "val/").otherwise("x/"), F.col("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", R.split_of(path).alias("split"))


@query(with_views("ocr_lines") + "select doc_id, line_index//5 as block, string_agg(text, ' ' order by line_index) as text, min(x1) as x1, max(x2) as x2 from ocr_lines group by 1, 2")
def src09_words_to_lines(spark, sf_dir):
    rows = load(spark, sf_dir, "ocr_lines").withColumns({"block": F.floor(F.col("line_index") / 5), "par": F.lit(0), "line": F.lit(0), "word_index": F.col("line_index"), "conf": F.lit(90)})
    return R.lines_of_words(rows).select("doc_id", "block", "text", "x1", "x2")


@query("select distinct user_id as fingerprint from events where event_type in ('view', 'click') and user_id % 3 <> 0")
def src10_cache_hits(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    cache = rows.select(F.col("user_id").alias("fingerprint"), F.when(F.col("event_type").isin("view", "click"), 2).otherwise(1).alias("schema_version"), F.when(F.col("user_id") % 3 != 0, 1).alias("x1"))
    return R.cached(rows.select(F.col("user_id").alias("fingerprint")).distinct(), cache)


LOG = "select event_id as seq, user_id as document_id, event_type as status from events"


@query(LOG + " where event_id % 3 = 0")
def src11_correction_log(spark, sf_dir):
    """A log of corrections appended in two parts and read back; broken lines,
    such as a truncated last one, are left out."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("seq"), F.col("user_id").alias("document_id"), F.col("event_type").alias("status"))
    R.append_log(rows.where("seq % 2 = 0"), folder)
    R.append_log(rows.where("seq % 2 = 1"), folder)
    spark.createDataFrame([('{"seq": 1, "docum',)], "value string").write.mode("append").text(folder)
    return R.read_log(spark, folder, "seq long, document_id long, status string").where("seq is not null")


@query("select c_custkey, c_name, c_mktsegment, cast(c_acctbal as double) as c_acctbal from customer")
def src16_csv(spark, sf_dir):
    """A table written as CSV with a header and read with its schema."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    rows.write.option("header", True).csv(folder)
    return spark.read.schema(rows.schema).option("header", True).csv(folder)


@query(with_views("invoices") + "select doc_id % 5 as dataset, count(*) as documents, cast(sum(amount_ht) as double) as amount_ht from invoices group by 1")
def snk07_reports(spark, sf_dir):
    """A report of each dataset, written one folder a dataset and read again."""
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "invoices").groupBy((F.col("doc_id") % 5).alias("dataset")).agg(F.count("*").alias("documents"), F.sum("amount_ht").cast("double").alias("amount_ht"))
    rows.write.partitionBy("dataset").parquet(folder)
    return spark.read.schema("documents long, amount_ht double, dataset long").parquet(folder)


@query(A + "select document_id, max(log_seq) as log_seq, count(*) as attempts from attempts where execution_status = 'completed' group by document_id")
def snk06_checkpointed(spark, sf_dir):
    """The state of a run, replaced as a whole by each batch of its log."""
    state = _stream(spark, sf_dir).where("execution_status = 'completed'").groupBy("document_id").agg(F.max("log_seq").alias("log_seq"), F.count("*").alias("attempts"))
    return _run(spark, state, "complete")
