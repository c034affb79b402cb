"""Corrections by reviewers, their memory, and the gate for proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """fields (doc_id, field, value) with the last accepted or edited
    correction (doc_id, field, corrected, action, seq) in place of the value."""
    last = corrections.where(F.col("action").isin("accepted", "edited")).groupBy("doc_id", "field").agg(F.max_by("corrected", "seq").alias("corrected"))
    rows = fields.join(last, ["doc_id", "field"], "left")
    return rows.select("doc_id", "field", F.coalesce("corrected", "value").alias("value"), F.col("corrected").isNotNull().alias("was_corrected"))


def without_ignored(items: DataFrame, ignored: DataFrame) -> DataFrame:
    """Line items but those that a reviewer ignored (doc_id, row_index)."""
    return items.join(ignored, ["doc_id", "row_index"], "left_anti")


def memory(corrections: DataFrame, most: int = 50) -> DataFrame:
    """The most frequent corrected values of each tenant and field (a top-k
    report; ties to the value seen first)."""
    counts = corrections.groupBy("tenant_id", "field", "corrected").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    best = Window.partitionBy("tenant_id", "field").orderBy(F.desc("n"), "first_seq", "corrected")
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


PROTECTED = ("amount_ht", "tva_amount", "amount_ttc", "invoice_number")


def gate(proposals: DataFrame, evidence: DataFrame, fields: DataFrame, least: float = 0.85, protected: float = 0.90) -> DataFrame:
    """Proposals (doc_id, field, old_value, proposed_value, confidence, refs)
    with ``accepted`` and the checks that failed.

    References must exist among the document's evidence (doc_id, ref, text) and
    the proposed value must stand in the texts they name; the old value must be
    the current one.
    """
    named = proposals.select("doc_id", "field", F.explode("refs").alias("ref")).join(evidence, ["doc_id", "ref"], "left")
    named = named.groupBy("doc_id", "field").agg(F.count_if(F.col("text").isNull()).alias("unknown"), F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("texts"))
    rows = proposals.join(named, ["doc_id", "field"], "left").join(fields.select("doc_id", "field", F.col("value").alias("current")), ["doc_id", "field"], "left")
    checks = {
        "field": F.col("current").isNull() & F.col("old_value").isNotNull(),
        "confidence": F.col("confidence") < least,
        "protected": F.col("field").isin(*PROTECTED) & (F.col("confidence") < protected),
        "references": (F.size("refs") <= 0) | (F.coalesce("unknown", F.lit(1)) > 0),
        "evidence": ~F.contains(F.lower(F.coalesce("texts", F.lit(""))), F.lower("proposed_value")),
        "old_value": ~F.col("old_value").eqNullSafe(F.col("current")),
    }
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return rows.select("doc_id", "field", "proposed_value", failed.alias("failed")).withColumn("accepted", F.size("failed") == 0)


def evidence_lines(lines: DataFrame, relevant, most_chars: int) -> DataFrame:
    """Relevant lines and their neighbours until the budget of characters is
    passed (the first one always stays)."""
    own = Window.partitionBy("doc_id").orderBy("line_index")
    near = lines.withColumn("near", F.max(relevant.cast("int")).over(own.rowsBetween(-1, 1))).where("near = 1")
    running = near.withColumns({"chars": F.sum(F.length("text")).over(own.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(own)})
    return running.where((F.col("chars") <= most_chars) | (F.col("place") == 1)).drop("near", "place")
