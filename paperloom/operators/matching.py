"""Names and records: comparison of party names, greedy matching of line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def canonical_name(c: Column) -> Column:
    """Words of a party name without role label, repeats and legal form."""
    return T.without_legal_form(T.without_repeats(T.without_role_label(T.plain_words(c))))


def ratios(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with token_set, token_sort and characters: matching-block
    ratios (0 to 100) of two texts, in Arrow batches."""

    def run(a, b):
        import pandas as pd
        from difflib import SequenceMatcher

        out = []
        for x, y in zip(a.fillna(""), b.fillna("")):
            tx, ty = x.split(), y.split()
            forms = ((" ".join(sorted(set(tx))), " ".join(sorted(set(ty)))), (" ".join(sorted(tx)), " ".join(sorted(ty))), (x, y))
            out.append([100.0 * SequenceMatcher(None, *f, autojunk=False).ratio() for f in forms])
        return pd.DataFrame(out, columns=["token_set", "token_sort", "characters"])

    similar = F.pandas_udf(run, "token_set double, token_sort double, characters double")
    return pairs.withColumn("r", similar(F.col(left), F.col(right))).select(*pairs.columns, "r.*")


def compare_names(pairs: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """class of each pair: exact, canonical_exact, strong_fuzzy, partial,
    ambiguous, mismatch, unavailable."""
    rows = pairs.withColumns({"p": T.plain_words(F.col(predicted)), "t": T.plain_words(F.col(truth)), "cp": canonical_name(F.col(predicted)), "ct": canonical_name(F.col(truth))})
    settled = F.when((F.col("p") == "") | (F.col("t") == ""), "unavailable").when(F.col("p") == F.col("t"), "exact").when((F.col("cp") == F.col("ct")) & (F.col("cp") != ""), "canonical_exact")
    rows = ratios(rows.withColumn("settled", settled), "cp", "ct")
    tp, tt = T.significant_tokens(F.col("cp")), T.significant_tokens(F.col("ct"))
    shared = F.size(F.array_intersect(tp, tt)) > 0
    held = (F.size(F.array_except(tp, tt)) == 0) | (F.size(F.array_except(tt, tp)) == 0)
    kind = (
        F.when(F.col("settled").isNotNull(), F.col("settled"))
        .when(shared & (F.col("token_set") >= 90) & (F.col("token_sort") >= 85) & (F.col("characters") >= 80), "strong_fuzzy")
        .when(shared & held & (F.greatest(F.size(tp), F.size(tt)) >= 2) & (F.least(F.size(tp), F.size(tt)) >= 2), "partial")
        .when(shared & (F.col("token_set") >= 75), "ambiguous")
        .otherwise("mismatch")
    )
    return rows.select(*pairs.columns, kind.alias("match_class"))


def match_score(a: dict, b: dict) -> float:
    """0.45 description + 0.2 reference + 0.12 quantity + 0.1 price + 0.13 total."""
    words = [set(str(x.get("description") or "").lower().split()) for x in (a, b)]
    text = len(words[0] & words[1]) / max(len(words[0] | words[1]), 1)

    def near(name):
        x, y = a.get(name), b.get(name)
        return float(x is not None and y is not None and abs(float(x) - float(y)) <= max(0.01, 0.005 * abs(float(y))))

    same = float(bool(a.get("reference")) and a.get("reference") == b.get("reference"))
    return 0.45 * text + 0.2 * same + 0.12 * near("quantity") + 0.1 * near("unit_price") + 0.13 * near("line_total_ht")


def match_items(predicted: DataFrame, truth: DataFrame, least: float = 0.62) -> DataFrame:
    """Greedy one-to-one matching of the items of each document, greatest score
    first, ties to the greater row indexes: (doc_id, predicted_index,
    truth_index, score). Unmatched items of either side have a null partner.

    Documents come as one sorted stream a partition, so none costs a call of
    its own.
    """

    def matched(doc, a, b):
        scored = sorted(((match_score(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
        out, used_a, used_b = [], set(), set()
        for s, i, j in scored:
            if s < least:
                break
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((doc, a[i]["row_index"], b[j]["row_index"], round(s, 6)))
        out += [(doc, x["row_index"], None, None) for i, x in enumerate(a) if i not in used_a]
        return out + [(doc, None, y["row_index"], None) for j, y in enumerate(b) if j not in used_b]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("predicted_index", pa.int64()), ("truth_index", pa.int64()), ("score", pa.float64())])
        doc, sides, out = None, ([], []), []
        for batch in batches:
            for row in batch.to_pylist():
                if row["doc_id"] != doc:
                    out += matched(doc, *sides)
                    doc, sides = row["doc_id"], ([], [])
                sides[row["side"]].append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
            out = []
        out = matched(doc, *sides)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def side(rows, n):
        values = [F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "line_total_ht")]
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(n).alias("side"), F.col("row_index").cast("long").alias("row_index"), "description", "reference", *values)

    rows = side(predicted, 0).unionByName(side(truth, 1)).repartition("doc_id")
    rows = rows.sortWithinPartitions("doc_id", "side", F.asc_nulls_last("row_index"), "description", "reference", "quantity", "unit_price", "line_total_ht")
    return rows.mapInArrow(run, "doc_id long, predicted_index long, truth_index long, score double")


def physical_rows(lines: DataFrame, tolerance: float = 12) -> DataFrame:
    """Rows of a page: by centre and x, a line joins the first row whose running
    mean of centres is within the tolerance (doc_id, page_number, line_index,
    row).

    Pages come as one sorted stream a partition, so a task holds the open rows
    of one page and no page costs a call of its own.
    """

    def run(batches):
        import pyarrow as pa

        page, sums, counts = None, [], []
        for batch in batches:
            place = []
            for key in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
                if key[:2] != page:
                    page, sums, counts = key[:2], [], []
                c = key[2]
                for i, (s, n) in enumerate(zip(sums, counts)):
                    if abs(c - s / n) <= tolerance:
                        sums[i] += c
                        counts[i] += 1
                        break
                else:
                    i = len(sums)
                    sums.append(c)
                    counts.append(1)
                place.append(i)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(place, pa.int64())], ["doc_id", "page_number", "line_index", "row"])

    centre = ((F.col("y1") + F.col("y2")) / 2).cast("double").alias("c")
    rows = lines.select("doc_id", "page_number", "line_index", centre, "x1").repartition("doc_id", "page_number").sortWithinPartitions("doc_id", "page_number", "c", "x1", "line_index")
    return rows.mapInArrow(run, "doc_id long, page_number int, line_index int, row long")


def centre_clusters(values: Column, gap: float = 34) -> Column:
    """Means of clusters of sorted numbers; a number farther than ``gap`` above
    the running mean starts a new one. A fold in SQL functions."""
    empty = F.array().cast("array<struct<s:double,n:int>>")

    def step(acc, v):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["s"] + v).alias("s"), (last["n"] + 1).alias("n"))))
        return F.when((F.size(acc) == 0) | (v - last["s"] / last["n"] > gap), F.concat(acc, F.array(F.struct(v.alias("s"), F.lit(1).alias("n"))))).otherwise(joined)

    return F.transform(F.aggregate(F.sort_array(values.cast("array<double>")), empty, step), lambda c: c["s"] / c["n"])
