"""Field candidates from text lines and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

# Keywords of document types, most specific vocabulary first.
KEYWORDS = {
    "invoice": ("facture", "numero facture", "n facture", "total ttc", "tva", "invoice", "invoice number", "vat", "total amount", "amount due", "فاتورة", "رقم الفاتورة", "ضريبة", "المبلغ الجملي", "الإجمالي"),
    "delivery_note": ("bon de livraison", "livraison", "quantite livree", "quantité livrée", "delivery note", "delivered quantity", "shipped", "وصل تسليم", "إذن تسليم", "تسليم"),
    "credit_note": ("avoir", "facture d'avoir", "note de credit", "note de crédit", "credit note", "refund", "credit memo", "إشعار دائن", "إرجاع", "استرجاع"),
    "receipt": ("recu", "reçu", "ticket", "paiement recu", "paiement reçu", "receipt", "payment received", "وصل", "إيصال", "وصل دفع"),
    "purchase_order": ("bon de commande", "commande", "purchase order", "po number", "طلب شراء", "أمر شراء"),
}


def classify(docs: DataFrame, keywords: dict = KEYWORDS) -> DataFrame:
    """doc_id, document_type, n_matched, confidence: most keywords found, ties
    to the type listed first. One pass over the text, no join."""
    plain = F.lower(T.strip_accents(F.col("text")))
    hits = [sum(F.contains(F.col("plain"), F.lower(T.strip_accents(F.lit(k)))).cast("int") for k in ks).alias(t) for t, ks in keywords.items()]
    rows = docs.select("doc_id", F.coalesce(plain, F.lit("")).alias("plain")).select("doc_id", *hits)
    best = F.greatest(*[F.struct(F.col(t).alias("n"), F.lit(len(keywords) - i).alias("priority"), F.lit(t).alias("type")) for i, t in enumerate(keywords)])
    rows = rows.select("doc_id", best.alias("best"))
    n = F.col("best.n")
    return rows.select("doc_id", F.when(n > 0, F.col("best.type")).otherwise("unknown").alias("document_type"), n.alias("n_matched"), F.when(n > 0, F.least(F.lit(98), 45 + n * 14)).otherwise(0).alias("confidence_percent"))


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))


LABELS = {
    "invoice_number": (r"(?i)^facture n[^\p{L}\p{N}]+([\p{L}\p{N}].*)$", "0.86"),
    "invoice_date": (r"(?i)^date facture: (.*)$", "0.80"),
    "supplier_name": (r"(?i)^fournisseur: (.*)$", "0.70"),
    "customer_name": (r"(?i)^client: (.+)$", "0.70"),
    "amount_ht": (r"(?i)^total ht: (.*)$", "0.86"),
    "tva_amount": (r"(?i)^tva [0-9]+%: (.*)$", "0.82"),
    "amount_ttc": (r"(?i)^total ttc: ([0-9.,]+).*$", "0.90"),
}


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, field, value, score, line_index of labelled lines."""
    one = [F.when(F.col("line").rlike(p), F.struct(F.lit(f).alias("field"), F.trim(F.regexp_extract("line", p, 1)).alias("value"), F.lit(s).cast("decimal(4,2)").alias("score"))) for f, (p, s) in LABELS.items()]
    found = lines_of(docs).select("doc_id", "line_index", F.explode(F.array_compact(F.array(*one))).alias("c"))
    return found.select("doc_id", "c.field", "c.value", "c.score", "line_index").where("value <> ''")


def best_candidates(found: DataFrame) -> DataFrame:
    """The candidate of greatest score per field; of equals the first."""
    best = Window.partitionBy("doc_id", "field").orderBy(F.desc("score"), "line_index")
    return found.withColumn("at", F.row_number().over(best)).where("at = 1").drop("at")


def labelled_amounts(docs: DataFrame) -> DataFrame:
    """Amount of each label in document order, the last one wins."""
    label = F.regexp_extract(F.lower("line"), r"^(total ht|total ttc|tva)", 1)
    rows = lines_of(docs).select("doc_id", "line_index", label.alias("label"), N.amount(F.regexp_extract("line", r": *([0-9.,]+)", 1)).alias("amount")).where("label <> '' and amount is not null")
    return rows.groupBy("doc_id", "label").agg(F.max_by("amount", "line_index").alias("amount"))


#: Most items of one or two words.
TINY = 1000


def contained(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) where a document's text holds an item's text.

    A text that holds an item holds its second to fourth word whole, so three
    words in a row are an equi-join key; what meets is then checked in full.
    A shorter item of three words or more holds its middle whole: one word is
    the key. One or two words may stand inside longer words only; they are few
    (their number is checked) and go with the tasks.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    items = items.where("text is not null").select("item_id", F.col("text").alias("needle"), words(F.col("text")).alias("w"))
    docs = docs.where("text is not null").select("doc_id", "text")
    key = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    long = items.where(F.size("w") >= 5).select("item_id", "needle", key(F.col("w"), F.lit(1)).alias("key"))
    keyed = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") >= 3)
    keyed = keyed.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: key(F.col("w"), i)))).alias("key"))
    found = keyed.join(long, "key").select("doc_id", "item_id", "needle").join(docs, "doc_id").where(F.contains("text", "needle"))
    middle = items.where(F.size("w").between(3, 4)).select("item_id", "needle", F.get("w", F.lit(1)).alias("key"))
    single = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("key"))
    mid = single.join(middle, "key").select("doc_id", "item_id", "needle").join(docs, "doc_id").where(F.contains("text", "needle"))
    out = found.select("item_id", "doc_id").unionByName(mid.select("item_id", "doc_id"))
    tiny = items.where(F.size("w") < 3).select("item_id", "needle").limit(TINY + 1)
    few = [tuple(r) for r in tiny.collect()]
    if len(few) > TINY:
        raise ValueError(f"more than {TINY} items of one or two words; match these by their own words")
    if few:
        hits = F.filter(F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(n).alias("needle")) for i, n in few]), lambda x: F.contains(F.col("text"), x["needle"]))
        out = out.unionByName(docs.select(F.explode(hits).alias("x"), "doc_id").select("x.item_id", "doc_id"))
    return out
