"""Each operator against a brute-force version, a round trip or held-out
labels, and the defined cases: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, html, jaccard, mixing, pii, quality, suffixes, topk, toxicity, warc
from paperloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = {"id": 1, "n": 2, "cell": 3, "tid": 4, "size": 5, "target": 6.0, "score": 7.0, "kind": "x", "base": "y", "rank": 8}


def documents(spark, texts, clash=True):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


def odd_texts():
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 300)}" for _ in range(200)]
    texts = [None, "", " \n\t", "one", "one two", "A b c", "a B c", "x" * 30_000, "é ü ß 漢字 🎉 " * 20, "same line\n" * 60]
    for _ in range(25):
        t = list(words[: rng.randint(60, 200)])
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = f"v{rng.randint(0, 9999)}"
        texts.append(" ".join(t))
    return texts + texts[-4:] + [" ".join(words)] * 3


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, odd_texts()).cache()


def shingles(text, width):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + width]) for i in range(max(len(ws) - width + 1, 1))} if ws else set()


def brute_components(rows, width, p, q):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * q >= (len(sets[a]) + len(sets[b]) - both) * p:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,p,q,cell,local", [(3, 9, 10, 8, 2048), (5, 8, 10, 2, 4)])
def test_jaccard(spark, docs, monkeypatch, width, p, q, cell, local):
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "LOCAL", local)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(docs, width, p, q).collect()}
    assert got == brute_components(rows, width, p, q)


def test_jaccard_keeps_one(spark, docs):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 8, 10)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(1, 3) for _ in range(rng.randint(0, 50))] + [0]
        assert suffixes.sais(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(110))
    texts = [None, "", "x" * 399, "x" * 400, "ab " * 300, "é" * 500, "\x00" * 450]
    for _ in range(20):
        k = rng.randint(390, len(passage))
        o = rng.randint(0, len(passage) - k)
        texts.append("".join(rng.choice("abc ") for _ in range(rng.randint(0, 300))) + passage[o : o + k] + "".join(rng.choice("abc ") for _ in range(rng.randint(0, 300))))
    texts += [texts[-1]] * 2
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(x[i : i + 400] for x in raw for i in range(len(x) - 399))
    want = []
    for i, x in enumerate(raw):
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - 399):
            if count[x[s : s + 400]] > 1:
                gone[s : s + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    assert sorted(map(tuple, suffixes.dedup_report(documents(spark, texts)).collect())) == want


def test_bpe_equals_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    own = bpe.encoder()
    rng = random.Random(5)
    texts = ["<|endoftext|>a<|startoftext|>", "Σ ΑΣ", "a" * 3000] + [t or "" for t in odd_texts()]
    texts += ["".join(rng.choice("abC 'sre\n\x85é漢²½#<|>🎉İı") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    row = {r["doc_id"]: r for r in bpe.encode_report(docs).collect()}
    assert len(row) == docs.count()
    assert row[0]["n_tokens"] == 0 and row[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def brute_pii(text):
    found = []

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    ):
        found += [(m.start(), pii.KINDS.index(kind), m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_pii(spark):
    texts = [None, "", "a@b.c_d@e.f x@y.zz.", "🎉 q@w.ee 1.2.3.4.5 999.1.1.1 001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (702) 555-0742, +12", "5" * 4000 + " a@" + "b." * 3000, " a@b.c ", "1 " * 3000]
    rows = {r["doc_id"]: r for r in pii.pii_report(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["base_sha256"] == hashlib.sha256(brute_pii(t).encode()).hexdigest(), i
        assert set(filter(None, brute_pii(t).split(","))) <= set(rows[i]["spans"].split(","))
    written_out = pii.pii_report(documents(spark, ["mail jo [at] host [dot] com now", "call (212) 555-0199 today", "order 123.456.7890"])).orderBy("doc_id").collect()
    assert [bool(r["spans"]) for r in written_out] == [True, True, False]
    clean = pii.redact(documents(spark, ["x a@b.cc y", None])).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["x [EMAIL] y", None] and clean[0]["n_chars"] == 11


def brute_quality(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = collections.Counter(zip(ws, ws[1:], ws[2:]))
    cover = {j for i, x in enumerate(zip(ws, ws[1:], ws[2:])) if count[x] > 1 for j in (i, i + 1, i + 2)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.quality_report(docs).collect():
        want = brute_quality(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    ledger = quality.ledger(docs).cache()
    kept = ledger.where(quality.keeps(("clean", 1))).count()
    for r in quality.ablations(ledger, ("clean", 1)).collect():
        rest = [n for n in quality.POLICIES["clean", 1] if n != r["rule"]]
        assert r["kept_without"] == ledger.where(f"failed & {quality.mask(rest)} = 0").count() >= kept


def test_mixing(spark, docs):
    rows = mixing.mix_report(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))
    total = sum(r["size"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    goals = {source[i]: (r["target"], r["source_size"]) for i, r in by.items()}
    assert abs(sum(t for t, _ in goals.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-6 for t, s in goals.values())
    assert sum(r["taken"] for r in rows) <= total
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    again = mixing.mix(docs.unionByName(docs.where("doc_id = 12")))
    assert again.columns == docs.columns and again.count() > 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], 1) for i in range(300)]
    rows += [(i, [0.5] * 8, 2) for i in range(300, 500)] + [(500, None, 0), (550, [float("nan")] * 8, 0), (600, [1.0, None], 0), (650, [], 0), (650, [0.25] * 3, 0), (700, [0.5] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit(1))
    good = [(i, np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v))))) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    for size in (16_384, 20):
        topk.BLOCK_ROWS, before = size, topk.BLOCK_ROWS
        try:
            assert sorted(map(tuple, topk.top_k(df, pivots=6, rings=3).collect())) == sorted(want)
        finally:
            topk.BLOCK_ROWS = before
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_warc(spark):
    big = "<p>" + "ö" * 1000
    rows = [(1, "http://a/x", big), (2, "http://a/y z\r\n", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", big), (None, "u", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(pages).collect()}
    for i, _, page in rows:
        raw = (page or "").encode()
        first = i in (1, 2)
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if first else "response", 7 if first else None)
    member = warc.record(1, "u", b"abc", None)
    import io
    import zlib

    assert [warc.parsed(m)["payload"] for m in warc.members(io.BytesIO(member * 3))] == [b"abc"] * 3
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(member[:-5])))
    raw = zlib.decompress(member, 31).replace(b"abc", b"abd")
    with pytest.raises(warc.DigestError):
        warc.parsed(raw)
    assert warc.round_trip(pages.where("page_id > 99")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="sidebar">Side</div>
<article><h1>Head {i} &amp; more</h1><p>One <b>bo</b>ld&nbsp;text<p>Two<br>lines &lt;x&gt;<div class="ad-box">Ad</div><form>Mail <input></form><aside>Note</aside>
<ul><li>a<li>b</ul></article><section id="comments"><p>First!</p></section><div class="cookie-notice">OK?</div><footer>&copy; Me</footer></body></html>"""


def test_html(spark):
    pages = [(i, f"http://h{i % 2}.example/{i}", PAGE.replace("{i}", str(i))) for i in range(8)]
    pages += [(8, None, None), (9, "odd", ""), (10, "http://x/", "plain <b>text"), (11, "http://y/", "<p>a <p"), (12, "http://h0.example/z", "<div><p>other page</div>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit(1))
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert len(got) == len(pages)
    for i in range(8):
        assert got[i]["text"] == f"Head {i} & more One bold text Two lines <x> a b"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (8, 9, 10, 11, 12)] == ["", "", "plain text", "a", "other page"]
    w = None
    for _, _, page in pages[:8]:
        t = html.tree(html.parse(page))
        w = t if w is None else html.merge(w, t)
    assert "#SLOT" in html.expression(w) and "<article>" in html.expression(w)


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["the", "of", "and", "river", "stone", "walk", "green", "house", "letter", "about"]
    bad = ["wretch", "vermin"]
    texts, labels = [], []
    for i in range(400):
        ws = [rng.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            ws[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(ws))
        labels.append((i, 1, int(toxic)))
    hidden = ["the wr3tch and", "a v e r m i n of", "verrrrmin house", "w.r.e.t.c.h walk", "VERM1N!!"]
    texts += [*hidden, None, "", "stone house"]
    df = documents(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_report(df, marks).collect()}
    held = [i for i in range(400) if rows[i]["held_out"]]
    assert held and sum(rows[i]["predicted"] == labels[i][2] for i in held) >= 0.98 * len(held)
    assert [rows[400 + i]["predicted"] for i in range(8)] == [1] * 5 + [0] * 3
    none = toxicity.toxicity_report(df, marks.where("doc_id < 0"))
    assert none.where("predicted = 1").count() == 0


def test_empty_tables(spark):
    none = documents(spark, ["x"]).where("doc_id < 0")
    for f in (jaccard.join, suffixes.dedup_report, bpe.encode_report, pii.pii_report, quality.quality_report, mixing.mix_report, jaccard.one_of_each, mixing.mix, pii.redact):
        assert f(none).count() == 0, f
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(pages).count() == 0
    assert toxicity.toxicity_report(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p
    from paperloom.llm.common import table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns, name
        docs = out
    tokens = p.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == docs.count() > 0
