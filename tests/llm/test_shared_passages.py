"""Passages of over 50 words that another text has too, against all windows."""

import collections
import random

import pytest

from paperloom.llm import passages, suffixes

from .test_operators import documents


@pytest.mark.parametrize("often", [1000, 10**9])
def test_shared_passages(spark, monkeypatch, often):
    monkeypatch.setattr(suffixes, "OFTEN", often)
    rng = random.Random(11)
    some = lambda n: [f"{rng.choice('abcdeé')}{rng.randint(0, 99)}" for _ in range(n)]
    passage, own = some(60), some(60)
    texts = [None, "", " ".join(some(30) + passage[:51] + some(20)), "\n ".join(some(200) + [w.upper() if w.isascii() else w for w in passage[:51]])]
    texts += [" ".join(some(40) + passage[-50:] + some(5)), " ".join(own + some(7) + own), " ".join(["of,"] * 90), " ".join(["of,"] * 51 + some(9))]
    texts += [" ".join(some(51))] * 2 + [" ".join(some(50))] * 2 + [" ".join(some(200))] * 2 + ["of, " * 50]
    for _ in range(30):
        o, k = rng.randint(0, 15), rng.randint(40, 60)
        texts.append(" ".join(some(rng.randint(0, 60)) + passage[o : o + k] + some(rng.randint(0, 60))))
    words = [(t or "").lower().split() for t in texts]
    windows = [{tuple(w[i : i + passages.WORDS]) for i in range(len(w) - passages.WORDS + 1)} for w in words]
    count = collections.Counter(x for s in windows for x in s)
    want = [any(count[x] > 1 for x in s) for s in windows]
    rows = {r["doc_id"]: r for r in suffixes.passage_report(documents(spark, texts)).collect()}
    assert [rows[i]["has_shared_passage"] for i in range(len(texts))] == want
    assert want[2:8] == [True, True, False, False, True, True] and want[8:14] == [True, True, False, False, True, True]
    # What is removed is the contract's, whether or not passages are asked for.
    plain = {r["doc_id"]: r for r in suffixes.dedup_report(documents(spark, texts)).collect()}
    assert all(tuple(rows[i])[:6] == tuple(plain[i]) for i in rows)
    assert rows[2]["n_removed"] == rows[8]["n_removed"] == 0


def test_op6_tells_shared_passages(spark):
    import __spark_entry__ as e

    out = e.queries()["op6_suffix_array_dedup"](spark, "/root/testdata/sf0.001")
    assert "has_shared_passage" in out.columns and out.where("has_shared_passage is null").count() == 0
    assert suffixes.passage_report(documents(spark, ["x"]).where("doc_id < 0")).count() == 0
