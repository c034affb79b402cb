"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents are shuffled by a hash; each gets as
virtual finish time the source's words up to and including it, divided by the
source's target weight. A source whose target exceeds its size goes round
again. The mix is the list of all documents by finish time, cut at the total
budget.

Distribution: nothing but ``(doc_id, source, size)`` is shuffled, never text.
The running sums are taken in hash buckets of each source, whose offsets come
from pre-aggregated bucket sums, so one source with a third of all rows is
spread over ``2**12`` groups. The only single-task steps see one row a source
(ranks and water level) or the few entries around the cut.

Defined cases: a null text or one without words has size 0 and takes no
words; null is a source of its own, last in order; repeated rows and repeated
doc_ids are documents of their own; ties of the hash go by doc_id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Hex digits of the shuffling hash that name a bucket.
BUCKET_DIGITS = 3


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the shuffling hash."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )


def targets(rows: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: source, rank, source_size, target.

    Weights repeat over the sources in code point order. A target stops at
    ``max_repeats`` times the source's size; the excess goes to the others by
    weight. With sources by cap over weight, those under the water level come
    first, so running sums give the level at each of them.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(whole) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    level = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, every = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", rest / weight).withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("at"), "rank", "level"))).over(every)
    ranked = ranked.withColumn("water", first["level"])
    return ranked.select("source", "rank", "source_size", F.when(F.col("open"), F.col("water") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def schedule(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, cum (the
    source's words up to it in shuffled order), repeats (times the mix takes
    it)."""
    rows = cut(sized(docs), "sized").withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    goal = cut(targets(rows, weights, max_repeats), "targets")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("cum", F.col("offset") + F.sum("size").over(in_bucket)).drop("s", "b", "offset", "bucket", "key")
    goal = goal.withColumnRenamed("source", "s")
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = cut(placed, "placed")

    def ends(turn: int):
        return F.col("cum") + F.lit(turn) * F.col("source_size")

    within = sum((ends(e) <= F.col("target")).cast("long") for e in range(max_repeats))
    total, taken = placed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("size") * within), F.lit(0))).first()
    # What a document's turn ends after its source's share competes for the rest of the budget.
    late = placed.where(F.col("size") > 0).select("size", "source_size", "target", "rank", "cum", F.explode(F.array(*map(F.lit, range(max_repeats)))).alias("turn"))
    late = late.withColumn("end", F.col("cum") + F.col("turn") * F.col("source_size"))
    late = late.where((F.col("end") > F.col("target")) & (F.col("end") - F.col("target") <= total - taken))
    late = late.select("size", F.struct((F.col("end") / F.col("target")).alias("finish"), F.col("rank"), F.col("end")).alias("at"))
    late = late.withColumn("sum", F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    last = late.where(F.col("sum") <= total - taken).agg(F.max("at")).first()[0]

    def goes(turn: int):
        kept = ends(turn) <= F.col("target")
        if last is not None:
            kept |= F.struct(ends(turn) / F.col("target"), F.col("rank"), ends(turn)) <= F.struct(F.lit(last[0]), F.lit(last[1]), F.lit(last[2]).cast("long"))
        return F.when(kept, 1).otherwise(0)

    repeats = F.when(F.col("size") > 0, sum(goes(e) for e in range(max_repeats))).otherwise(F.when(ends(0) <= F.col("target"), 1).otherwise(0))
    return placed.withColumn("repeats", repeats.cast("long"))


def mix_report(docs: DataFrame) -> DataFrame:
    """The contract's view: a row a document with the words that the mix takes."""
    return schedule(docs).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("repeats")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each document as often as taken, by virtual finish time.

    Rows of one doc_id take as many turns as their schedule has rows for it,
    so repeated rows stay as they are. The text moves once, to its turns.
    """
    plan = schedule(docs, weights, max_repeats).where(F.col("repeats") > 0)
    turns = plan.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix_key"),
        F.coalesce("source", F.lit("")).alias("mix_source"),
        F.struct("size", "cum").alias("mix_order"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("repeats").cast("int") - 1), lambda e: F.coalesce(F.try_divide(F.col("cum") + e * F.col("source_size"), F.col("target")), F.lit(0)))).alias("finish"),
    )
    turns = turns.withColumn("mix_size", F.col("mix_order.size"))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix_key"),
        F.coalesce("source", F.lit("")).alias("mix_source"),
        F.struct(*docs.columns).alias("doc"),
    )
    on = ["mix_key", "mix_source"]
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # Rows of one doc_id, source and size take their turns by text.
        on += ["mix_size", "copy"]
        same = Window.partitionBy("mix_key", "mix_source", "mix_size")
        texts = texts.withColumn("mix_size", F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long"))
        texts = texts.withColumn("copy", F.row_number().over(same.orderBy(F.xxhash64("doc.text"))))
        turns = turns.withColumn("copy", F.dense_rank().over(same.orderBy("mix_order.cum")))
    out = texts.join(turns.select(*on, "finish"), on).select("doc.*", "finish", "mix_key")
    return out.repartitionByRange("finish", "mix_key").sortWithinPartitions("finish", "mix_key").drop("finish", "mix_key")


SQL = """
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
         md5(concat('mix:', coalesce(cast(doc_id as varchar), ''))) as key from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rnk from sized group by source),
caps as (
  select *, cast(rnk % 3 + 1 as double) as w, cast(source_size as double) * 3 as cap from per),
levels as (
  select *, (sum(cast(source_size as double)) over () - coalesce(sum(cap) over (order by cap / w, rnk rows between unbounded preceding and 1 preceding), 0))
          / (sum(w) over () - coalesce(sum(w) over (order by cap / w, rnk rows between unbounded preceding and 1 preceding), 0)) as lvl from caps),
goal as (
  select source, rnk, source_size,
         case when cap >= lvl * w then (select arg_min(lvl, cap / w * 1e6 + rnk * 1e-6) from levels where cap >= lvl * w) * w else cap end as target from levels),
placed as (
  select d.doc_id, d.size, g.source_size, g.target, g.rnk,
         cast(sum(d.size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and current row) as bigint) as cum
  from sized d join goal g on d.source is not distinct from g.source),
turns as (
  select *, cum + t.e * source_size as fin from placed, (values (0), (1), (2)) as t(e)),
budget as (
  select sum(case when e = 0 then size else 0 end) - sum(case when fin <= target then size else 0 end) as room from turns),
late as (
  select fin / target as v, rnk, fin, sum(size) over (order by fin / target, rnk, fin rows between unbounded preceding and current row) as used
  from turns, budget where size > 0 and fin > target and fin - target <= room),
last as (
  select max(row(v, rnk, fin)) as at from late, budget where used <= room)
select doc_id, size, source_size, target,
       cast(sum(case when size > 0 and (fin <= target or coalesce(row(fin / target, rnk, fin) <= last.at, false)) then size else 0 end) as bigint) as taken
from turns, last group by doc_id, size, source_size, target, cum
"""
