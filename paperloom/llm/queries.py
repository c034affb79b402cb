"""One thin query for each operator, over its whole table with production
parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, html, jaccard, mixing, pii, quality, suffixes, topk, toxicity, warc
from .common import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"), width=3, p=9, q=10)


def op2_html_main_text(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark, sf_dir):
    return bpe.encode_report(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark, sf_dir):
    return suffixes.passage_report(table(spark, sf_dir, "documents"))


def op7_source_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_html_main_text, op3_toxicity, op4_exact_topk, op5_bpe, op6_suffix_array_dedup, op7_source_mix, op8_warc, op9_pii, op10_quality)}
SQL = {"op4_exact_topk": topk.SQL, "op7_source_mix": mixing.SQL, "op8_warc": warc.SQL, "op10_quality": quality.SQL}
