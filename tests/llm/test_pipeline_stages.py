"""Every stage of the corpus pipeline against a version in plain Python."""

import re

import corpus_pipeline as p
from pyspark.sql import functions as F

from paperloom.llm import mixing, toxicity
from paperloom.llm.bpe import vocabulary_path
from paperloom.llm.common import table

from .test_operators import SF, brute_components

STAGES = dict(p.STAGES)


def docs_of(spark):
    return table(spark, SF, "documents")


def test_toxicity_stage(spark):
    docs = docs_of(spark)
    said = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_report(docs, table(spark, SF, "labels")).collect()}
    kept = [r["doc_id"] for r in STAGES["toxicity"](spark, docs, SF).collect()]
    assert sorted(kept) == sorted(i for i, n in said.items() if not n)


def test_near_duplicate_stage(spark):
    docs = docs_of(spark)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 8, 10)
    kept = [r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, SF).collect()]
    assert sorted(kept) == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)


def test_pii_stage(spark):
    docs = docs_of(spark).unionByName(docs_of(spark).limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("ask a.b@c.org, or 10.0.0.7.")}))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    after = {r["doc_id"]: r for r in STAGES["pii"](spark, docs, SF).collect()}
    assert after.keys() == before.keys() and after[-1]["text"] == "ask [EMAIL], or [IP]."
    for i, r in after.items():
        assert not email.search(r["text"] or "") and r["n_chars"] == len(r["text"] or "")
        if "[" not in (r["text"] or ""):
            assert r["text"] == before[i]


def test_mixing_stage(spark):
    docs = docs_of(spark)
    said = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_report(docs).collect()}
    times = {r["doc_id"]: r["count"] for r in STAGES["mixing"](spark, docs, SF).groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 3
    for i, (size, taken) in said.items():
        assert taken == size * times.get(i, 0)


def test_bpe_stage(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    own.no_truncation()
    texts = {r["doc_id"]: r["text"] or "" for r in docs_of(spark).collect()}
    for r in STAGES["bpe"](spark, docs_of(spark), SF).collect():
        assert list(r["ids"]) == own.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_stages_of_nulls_and_of_nothing(spark):
    docs = docs_of(spark)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 15), (3, "one two three", "en", "s", 13), (3, "one two three", "en", "s", 13)], docs.schema)
    for name, stage in p.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0, name
        out = stage(spark, odd, SF)
        assert out.count() >= 1, name
        if name != "bpe":
            assert out.columns == docs.columns, name
