"""Business rules: rows, invoices, totals, confidence, readiness, risk.

Amounts are decimals, so every tolerance is exact. Rules are expressions over
one row; only the sums by document shuffle, on doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import split_methods

# Fixed values.
REASONABLE_RATES = (0, 7, 10, 13, 19, 20)
WEIGHTS = {"ocr": "0.18", "layout": "0.12", "table": "0.14", "fields": "0.20", "financial": "0.16", "validation": "0.12", "erp": "0.08"}
CAPS = {"invalid": "0.59", "needs_review": "0.79", "missing": "0.69", "not_ready": "0.84", "weak": "0.74"}
REQUIRED = ("invoice_number", "supplier_name", "customer_name", "invoice_date", "currency", "amount_ttc")


def money(x) -> Column:
    return F.lit(x).cast("decimal(18,6)")


def _some(**conditions: Column) -> Column:
    """The names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def check_rows(items: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """errors, warnings, missing, row_status and row_confidence of line items."""
    total = F.col("line_total_ht")
    delta = F.abs(F.col("quantity") * F.col("unit_price") - total).cast("decimal(24,6)")
    limit = F.greatest(money(tolerance), F.abs(total) * money("0.01"))
    rows = items.withColumn("delta", delta).withColumn("missing", _some(description=F.coalesce(F.trim("description"), F.lit("")) == "", quantity=F.col("quantity").isNull(), unit_price=F.col("unit_price").isNull(), total=total.isNull()))
    rows = rows.withColumn(
        "errors",
        _some(quantity=F.col("quantity") <= 0, unit_price=F.col("unit_price") < 0, total=total < 0, tax_rate=~F.col("tax_rate").between(0, 100), arithmetic=F.col("delta") > limit),
    ).withColumn("warnings", _some(rounding=(F.col("delta") > money("0.01")) & (F.col("delta") <= limit)))
    status = F.when(F.size("errors") > 0, "invalid").when((F.size("missing") > 0) | (F.size("warnings") > 0), "needs_review").otherwise("validated")
    rows = rows.withColumn("row_status", status)
    return rows.withColumn("row_confidence", F.when(F.col("row_status") == "invalid", F.lit("0.35")).when(F.col("row_status") == "needs_review", F.lit("0.62")).otherwise(F.lit("0.92")).cast("decimal(4,2)"))


def summarize_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("row_status") == "validated").alias("validated"),
        F.count_if(F.col("row_status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("row_status") == "invalid").alias("invalid"),
        F.round(F.sum("row_confidence").cast("double") / F.count("*"), 3).alias("validation_score"),
    )


def line_statistics(rows: DataFrame) -> DataFrame:
    """summarize_rows and line_totals of checked rows in one aggregation."""
    return rows.groupBy("doc_id").agg(
        F.coalesce(F.sum("line_total_ht"), F.lit(0)).cast("decimal(18,3)").alias("ht"),
        F.count_distinct("tax_rate").alias("n_rates"),
        F.count_if(F.col("row_status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("row_status") == "invalid").alias("invalid"),
        F.round(F.sum("row_confidence").cast("double") / F.count("*"), 3).alias("validation_score"),
    )


def line_totals(items: DataFrame) -> DataFrame:
    """Totals of a document from its lines."""
    out = items.groupBy("doc_id").agg(F.coalesce(F.sum("line_total_ht"), F.lit(0)).cast("decimal(18,3)").alias("ht"), F.coalesce(F.sum("tax_amount"), F.lit(0)).cast("decimal(18,3)").alias("tva"), F.count_distinct("tax_rate").alias("n_rates"))
    return out.withColumn("ttc", (F.col("ht") + F.col("tva")).cast("decimal(18,3)"))


def check_totals(invoices: DataFrame, line_sums: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """financial_status (codes), consistent, financial_score of invoices."""
    rows = invoices.join(line_sums.withColumnRenamed("ht", "line_ht").drop("tva", "ttc"), "doc_id", "left")
    ttc_delta = F.abs(F.col("amount_ht") + F.col("tva_amount") - F.col("amount_ttc"))
    line_delta = F.abs(F.col("line_ht") - F.col("amount_ht"))
    errors = _some(totals=ttc_delta > F.greatest(money(tolerance), F.abs("amount_ttc") * money("0.005")), negative_ttc=F.col("amount_ttc") < 0, negative_vat=F.col("tva_amount") < 0)
    warnings = _some(
        insufficient=F.col("amount_ht").isNull() | F.col("tva_amount").isNull() | F.col("amount_ttc").isNull(),
        line_sum=line_delta > F.greatest(money(tolerance), F.abs("amount_ht") * money("0.02")),
        no_lines=F.col("line_ht").isNull(),
        mixed_rates=F.col("n_rates") > 1,
    )
    rows = rows.withColumn("financial_errors", errors).withColumn("financial_warnings", warnings)
    consistent = (F.size("financial_errors") == 0) & ~F.array_contains("financial_warnings", "insufficient") & ~F.array_contains("financial_warnings", "line_sum")
    score = F.when(F.size("financial_errors") > 0, "0.35").when(F.size("financial_warnings") > 0, "0.68").otherwise("0.95").cast("decimal(4,2)")
    return rows.withColumn("consistent", consistent).withColumn("financial_score", score)


def check_invoices(invoices: DataFrame, as_of) -> DataFrame:
    """errors, warnings and status of invoices; ``as_of`` stands for today."""
    apart = F.abs(F.col("amount_ht") + F.col("tva_amount") - F.col("amount_ttc"))
    limit = F.greatest(money("0.05"), F.abs("amount_ttc") * money("0.001"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = invoices.withColumn("errors", _some(ttc_not_positive=F.col("amount_ttc") <= 0, mismatch=apart > limit))
    rows = rows.withColumn(
        "warnings",
        _some(
            reference=blank("invoice_number"),
            date=F.col("invoice_date").isNull(),
            future=F.col("invoice_date") > F.lit(as_of).cast("date"),
            ttc=F.col("amount_ttc").isNull(),
            rounding=(apart > money("0.01")) & (apart <= limit),
            unchecked=F.col("amount_ht").isNull() | F.col("tva_amount").isNull() | F.col("amount_ttc").isNull(),
            supplier=blank("supplier_name"),
            currency=blank("currency"),
        ),
    )
    return rows.withColumn("status", F.when(F.size("errors") > 0, "invalid").when(F.size("warnings") > 0, "needs_review").otherwise("valid"))


def suspicious_rate(rate: Column) -> Column:
    """Farther than half a point from every usual rate."""
    return F.least(*[F.abs(rate - r) for r in REASONABLE_RATES]) > 0.5


def overall_confidence(**parts: Column) -> Column:
    """Weighted mean of the parts; a missing part counts 0, a missing export
    part 1."""
    total = sum(F.coalesce(parts[k], F.lit(1 if k == "erp" else 0)).cast("decimal(9,3)") * F.lit(w).cast("decimal(4,2)") for k, w in WEIGHTS.items())
    return total.cast("decimal(12,5)").cast("decimal(9,3)")


def capped(score: Column, status: Column, missing: Column, ready: Column, financial: Column, validation: Column) -> Column:
    """The least of a score and the caps that apply."""
    cap = lambda k: F.lit(CAPS[k]).cast("decimal(9,3)")
    none = F.lit(None).cast("decimal(9,3)")
    return F.least(score.cast("decimal(9,3)"), F.when(status == "invalid", cap("invalid")).when(status == "needs_review", cap("needs_review")).otherwise(none), F.when(missing, cap("missing")), F.when(~ready, cap("not_ready")), F.when((financial < F.lit("0.5").cast("decimal(4,2)")) | (validation < F.lit("0.5").cast("decimal(4,2)")), cap("weak")))


def missing_required(*names: str) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) == "", F.lit(n)) for n in names or REQUIRED]))


def readiness(rows: DataFrame) -> DataFrame:
    """erp_score and erp_status from confidence, financial_score, consistent,
    financial_errors, invalid, needs_review, validation_score."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence").cast("double") * 0.45 + F.col("financial_score").cast("double") * 0.30 + F.col("validation_score") * 0.25))
    rows = rows.withColumn("missing_fields", missing_required()).withColumn("erp_score", score)
    rejected = (F.size("financial_errors") > 0) | (F.col("invalid") > 0)
    review = (F.size("missing_fields") > 0) | (F.col("needs_review") > 0) | (F.col("erp_score") < 0.78) | ~F.col("consistent")
    return rows.withColumn("erp_status", F.when(rejected, "Rejected").when(review, "Needs Review").otherwise("ERP Ready"))


DUPLICATE_KEYS = ("invoice_number", "supplier_name", "invoice_date", "customer_name", "amount_ttc")


def _key_rows(invoices: DataFrame, least: int, exactly: bool, pairs: Column | None = None) -> DataFrame:
    """(doc_id, amount, kind, key): a row for each set of at least (or exactly)
    ``least`` of the five keys that a document has. Amounts stand in cells of two
    cents on two grids, so that amounts within a cent share a cell. ``pairs``
    leaves out sets that hold a pair of keys whose bit isn't set."""
    from itertools import combinations

    split_methods(invoices.sparkSession)
    cents = F.col("amount_ttc") * 100
    filled = [F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) != "", F.col(n).cast("string")) for n in DUPLICATE_KEYS[:-1]]
    grids = [F.concat(F.lit("0|"), F.floor(cents / 2).cast("string")), F.concat(F.lit("1|"), F.floor((cents + 1) / 2).cast("string"))]
    options, kind = [], 0
    for size in [least] if exactly else range(least, 6):
        for chosen in combinations(range(5), size):
            kind += 1
            for grid in grids if 4 in chosen else [None]:
                parts = [filled[i] if i < 4 else grid for i in chosen]
                whole = parts[0].isNotNull()
                for x in parts[1:]:
                    whole = whole & x.isNotNull()
                if pairs is not None:
                    need = sum(1 << (1 << i) + (1 << j) for i, j in combinations(chosen, 2))
                    whole = whole & (pairs.bitwiseAND(F.lit(need).cast("long")) == need)
                options.append(F.when(whole, F.struct(F.lit(sum(1 << i for i in chosen)).alias("kind"), F.concat_ws(chr(31), *parts).alias("key"))))
    rows = invoices.select("doc_id", F.col("amount_ttc").alias("amount"), F.explode(F.array_compact(F.array(*options))).alias("x"))
    return rows.select("doc_id", "amount", "x.kind", "x.key")


def _near(kind: Column, a: Column, b: Column) -> Column:
    return (kind.bitwiseAND(16) == 0) | (F.abs(a - b) <= money("0.01"))


def duplicate_pairs(invoices: DataFrame) -> DataFrame:
    """Pairs of documents (a < b) that agree on two or more of five keys.

    Pairs that agree on two keys agree on one of ten pairs of keys, so a
    document has a row for each of these and one equi join finds all; both
    sides are the same exchange. No key is joined alone.
    """
    rows = _key_rows(invoices, 2, True)
    x, y = (rows.select(F.col("doc_id").alias(n), "kind", "key", F.col("amount").alias(f"{n}_amount")) for n in "ab")
    both = x.join(y, ["kind", "key"]).where((F.col("a") < F.col("b")) & _near(F.col("kind"), F.col("a_amount"), F.col("b_amount")))
    pairs = both.groupBy("a", "b").agg(F.bit_or("kind").alias("fields"))
    n = F.bit_count("fields")
    return pairs.select("a", "b", n.alias("n_matched"), F.least(F.lit(1.0), (45 + n * 11) / 100).alias("confidence"))


def shared_pairs(invoices: DataFrame) -> DataFrame:
    """doc_id and pairs: a bit for each pair of keys that a document shares with
    another, at the number of the pair's kind; documents without any are left
    out. Cells are 64-bit hashes, so a bit can be one too many, none is missing."""
    rows = _key_rows(invoices, 2, True).select("doc_id", "kind", F.xxhash64("kind", "key").alias("cell"))
    crowded = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    return rows.join(crowded, "cell", "left_semi").groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, kind)")).alias("pairs"))


def duplicate_degrees(invoices: DataFrame) -> DataFrame:
    """doc_id and n_matched: the most keys that a document shares with any one
    other. No pairs are made: cells count their documents, with the two least
    and two greatest amounts, so a group of any size costs a row a document.
    A set of keys is shared only where each pair of them is, so the short rows
    of ``shared_pairs`` decide which sets are written out with their texts."""
    rows = _key_rows(invoices.join(shared_pairs(invoices), "doc_id"), 2, False, F.col("pairs"))
    cells = rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high")).where("n > 1")
    met = rows.join(cells, ["kind", "key"])
    whole = (F.col("kind").bitwiseAND(16) == 0) | (F.col("high") - F.col("low") <= money("0.01"))
    sure = met.where(whole).groupBy("doc_id").agg(F.max(F.bit_count("kind")).alias("n_matched"))
    # Cells whose amounts are more than a cent apart: the neighbour by amount.
    own = Window.partitionBy("kind", "key").orderBy("amount", "doc_id")
    gap = F.least(F.col("amount") - F.lag("amount").over(own), F.lead("amount").over(own) - F.col("amount"))
    open_cells = met.where(~whole).withColumn("gap", gap).where(F.col("gap") <= money("0.01"))
    rest = open_cells.groupBy("doc_id").agg(F.max(F.bit_count("kind")).alias("n_matched"))
    return sure.unionByName(rest).groupBy("doc_id").agg(F.max("n_matched").alias("n_matched"))


def consistent_triples(candidates: DataFrame, least: str = "0.05", rate: str = "0.002") -> DataFrame:
    """Per document the best (ht, tva, ttc) of candidates (doc_id, field, value,
    score) whose sum fits: greatest sum of scores minus mismatch."""
    of = lambda f: candidates.where(F.col("field") == f).select("doc_id", F.col("value").alias(f), F.col("score").alias(f"{f}_score"))
    rows = of("amount_ht").join(of("tva_amount"), "doc_id").join(of("amount_ttc"), "doc_id")
    apart = F.abs(F.col("amount_ht") + F.col("tva_amount") - F.col("amount_ttc"))
    rows = rows.withColumn("apart", apart).where(F.col("apart") <= F.greatest(money(least), F.abs("amount_ttc") * money(rate)))
    rows = rows.withColumn("fit", (F.col("amount_ht_score") + F.col("tva_amount_score") + F.col("amount_ttc_score") - F.col("apart")).cast("decimal(18,6)"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("fit"), "amount_ht", "tva_amount", "amount_ttc")
    return rows.withColumn("at", F.row_number().over(best)).where("at = 1").select("doc_id", "amount_ht", "tva_amount", "amount_ttc", "fit")
