"""Queries that SQL can express against their SQL, small limits that force the
ways for large groups, and cases of single operators."""

import decimal
import hashlib
import os
import random

import duckdb
import pytest

from paperloom.llm import jaccard, mixing, pii, quality, suffixes, toxicity, warc
from paperloom.llm.queries import QUERIES, SQL

from .test_operators import SF, brute_components, documents


def canonical(rows):
    value = lambda v: float(v) if isinstance(v, decimal.Decimal) else round(v, 6) if isinstance(v, float) else v
    return sorted(([value(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = c.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = [names.index(x) for x in cols]
    assert canonical(map(tuple, df.select(*cols).collect())) == canonical([[r[i] for i in order] for r in found.fetchall()])


@pytest.fixture
def small_limits():
    names = {"CELL": 2, "LOCAL": 12, "TURNS": 1, "PAIRS": 0, "GROUP": 4, "CLUSTER": 10, "BUFFER": 300, "PART": 500}
    before = {n: getattr(jaccard, n) for n in names}
    for n, v in names.items():
        setattr(jaccard, n, v)
    yield
    for n, v in before.items():
        setattr(jaccard, n, v)


def test_jaccard_in_crowded_regions(spark, small_limits):
    """Families of near copies, some linked and some just not."""
    rng = random.Random(11)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 9)):
                t[rng.randrange(len(t))] = f"v{rng.randint(0, 9999)}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    for width, p, q in ((3, 9, 10), (5, 8, 10)):
        want = brute_components(rows, width, p, q)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(spark, texts), width, p, q).collect()}
        assert got == want


def test_suffixes_with_frequent_keys(spark):
    """Every key counts as frequent; two texts with one passage of 400 bytes."""
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(450)
    texts = [some(300) + passage + some(200), some(80) + passage, some(700), some(700)] + [some(900)] * 2
    before, suffixes.OFTEN = suffixes.OFTEN, 10**9
    try:
        rows = {r["doc_id"]: r for r in suffixes.dedup_report(documents(spark, texts)).collect()}
    finally:
        suffixes.OFTEN = before
    assert [rows[i]["n_removed"] for i in range(6)] == [450, 450, 0, 0, 900, 900]
    assert [rows[i]["has_repeats"] for i in range(6)] == [True, True, False, False, True, True]


def test_mix_near_targets(spark):
    texts = [" ".join(["w"] * (1 + i % 7)) for i in range(400)]
    rows = mixing.mix_report(documents(spark, texts)).collect()
    by = {}
    for r in rows:
        t, n = by.setdefault(round(r["target"], 6), [0, 0])
        by[round(r["target"], 6)] = [t + r["taken"], n + r["size"]]
    for target, (taken, _) in by.items():
        assert abs(taken - target) <= max(21, 0.05 * target)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


def test_mix_of_one_source_and_of_nothing(spark):
    one = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_report(one).collect()}
    assert got == {1: (3, 3), 2: (0, 0), 3: (0, 0)}
    empty = spark.createDataFrame([(1, "a b", "s"), (2, "", "t")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_report(empty).collect()}[2] == 0


def test_warc_of_repeated_rows(spark):
    page = "<p>" + "x" * 1200 + "</p>"
    df = spark.createDataFrame([(1, "http://a/", page), (1, "http://a/", page), (2, "http://b/", page), (3, "http://c/", "short"), (4, None, None)], "page_id long, url string, html string")
    rows = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(df).collect())
    digest = hashlib.sha1(page.encode()).hexdigest()
    assert [r[:4] for r in rows] == [(1, "revisit", 2, 1207), (1, "revisit", 2, 1207), (2, "response", None, 1207), (3, "response", None, 5), (4, "response", None, 0)]
    assert {r[4] for r in rows[:3]} == {digest}


def test_pii_and_quality_of_repeated_rows(spark):
    texts = ["mail a@b.org now", "mail a@b.org now", None]
    pi = [tuple(r)[1:] for r in pii.pii_report(documents(spark, texts)).orderBy("doc_id").collect()]
    assert pi[0] == pi[1] and pi[0][0] == 1 and pi[0][-1] is True and pi[2][-1] is False
    qu = [tuple(r)[1:] for r in quality.quality_report(documents(spark, texts)).orderBy("doc_id").collect()]
    assert qu[0] == qu[1]


def test_toxicity_of_long_and_repeated_texts(spark):
    rng = random.Random(8)
    plain = [f"word{chr(97 + i)}{chr(98 + i)}" for i in range(20)]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) + (" scoundrel" if i % 3 == 0 else "") for i in range(300)]
    long = " ".join(rng.choice(plain) for _ in range(40_000))
    more = [long, long + " sc0undr3l", long + " sc0undr3l", "scoun" + "d" * 90 + "rel"]
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_report(documents(spark, texts + more), marks).collect()}
    assert [rows[300 + i]["predicted"] for i in range(4)] == [0, 1, 1, 1]
    assert rows[301]["score"] == rows[302]["score"]
