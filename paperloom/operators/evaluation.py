"""Evaluation analytics over attempts and labels: histories, percentiles,
rates, co-occurrence, calibration, sampling.

Everything is a pre-aggregated group-by or a window over one document's
attempts; populations and thresholds are unpivoted in the row (map side), so
no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attempt_history(attempts: DataFrame) -> DataFrame:
    """attempt_number, previous_seq, previous_status, is_retry."""
    own = Window.partitionBy("document_id").orderBy("log_seq")
    return attempts.withColumns(
        {
            "attempt_number": F.row_number().over(own),
            "previous_seq": F.lag("log_seq").over(own),
            "previous_status": F.lag("execution_status").over(own),
        }
    ).withColumn("is_retry", F.col("attempt_number") > 1)


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The last attempt of each document in log order, without a sort: the
    maximum by sequence combines before the shuffle."""
    names = [c for c in attempts.columns if c != "document_id"]
    best = attempts.groupBy("document_id").agg(F.max_by(F.struct(*names), "log_seq").alias("x"))
    return best.select("document_id", *[F.col(f"x.{c}").alias(c) for c in names])


def pending(selected: DataFrame, done: DataFrame) -> DataFrame:
    return selected.join(done, "document_id", "left_anti")


def nearest_rank(values: Column, share: float) -> Column:
    """Percentile at the rounded (half to even) place of a sorted array."""
    return F.get(values, F.bround(F.lit(share) * (F.size(values) - 1), 0).cast("int"))


def performance(rows: DataFrame, populations: dict[str, Column]) -> DataFrame:
    """Per population: count, mean, median, p90, p95, max, within 30 seconds.

    A row is unpivoted to the populations it is in; durations of a population
    are counted by value first, so what meets in one place is the distinct
    durations, not the rows.
    """
    of = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in populations.items()])))
    values = rows.where("duration_seconds is not null").select(of.alias("population"), "duration_seconds").groupBy("population", "duration_seconds").agg(F.count("*").alias("n"))
    before = Window.partitionBy("population").orderBy("duration_seconds").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("population")
    ranked = values.withColumn("upto", F.sum("n").over(before)).withColumn("all", F.sum("n").over(whole))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("duration_seconds")))

    last = F.col("all") - 1
    return ranked.groupBy("population").agg(
        F.max("all").alias("n"),
        (F.sum((F.col("duration_seconds") * F.col("n")).cast("decimal(30,2)")).cast("double") / F.max("all")).alias("mean"),
        ((at(F.floor(last / 2)) + at(F.ceil(last / 2))).cast("double") / 2).alias("median"),
        at(F.bround(last * F.lit(0.9), 0)).cast("double").alias("p90"),
        at(F.bround(last * F.lit(0.95), 0)).cast("double").alias("p95"),
        F.max("duration_seconds").cast("double").alias("max"),
        F.sum(F.when(F.col("duration_seconds") <= 30, F.col("n")).otherwise(0)).alias("within_30"),
    )


def rate(condition: Column) -> Column:
    """Share of true among the rows where the condition is known, 4 digits."""
    return F.round(F.avg(condition.cast("int")), 4)


def code_pairs(rows: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent pairs of codes in ``codes`` arrays, by in-row pairs."""
    codes = F.array_sort(F.array_distinct("codes"))
    pairs = F.flatten(F.transform(codes, lambda a, i: F.transform(F.slice(codes, i + 2, F.greatest(F.size(codes) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(most)


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of score >= threshold against label.

    Scores are counted by the highest threshold they reach (map side); sums
    over the few thresholds make the rest.
    """
    step = F.aggregate(F.array(*[F.lit(t) for t in thresholds]), F.lit(0), lambda n, t: n + F.when(F.col("score") >= t, 1).otherwise(0))
    counts = rows.groupBy(step.alias("reached")).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    sums = [F.struct(F.lit(t).alias("threshold"), F.sum(F.when(F.col("reached") > i, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("reached") > i, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("reached") <= i, F.col("pos")).otherwise(0)).alias("fn")) for i, t in enumerate(thresholds)]
    out = counts.agg(F.array(*sums).alias("x")).select(F.inline("x"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return out.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)), "recall": F.when(tp + fn > 0, tp / (tp + fn)), "f1": F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn))})


def balanced_sample(rows: DataFrame, group: str, key: Column, per_group: int) -> DataFrame:
    """The rows of least key in each group (a sampling operator; the group
    limit applies before the shuffle)."""
    own = Window.partitionBy(group).orderBy(key)
    return rows.withColumn("sample_rank", F.row_number().over(own)).where(F.col("sample_rank") <= per_group)


def stage_timing(rows: DataFrame) -> DataFrame:
    """count, total, mean, max of seconds by stage."""
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.sum("seconds").cast("double").alias("total"), (F.sum("seconds").cast("double") / F.count("*")).alias("mean"), F.max("seconds").cast("double").alias("max"))
