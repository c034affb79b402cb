"""Long unrelated texts that share a passage: sketches settle their pairs, and
texts move only to pairs that may be linked."""

import random

import numpy as np

from paperloom.llm import jaccard

from .test_operators import brute_components, documents


def test_long_unrelated_texts_are_not_compared(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(300)]
    texts = [[word() for _ in range(4800)] + passage for _ in range(14)]
    for changed in (20, 100, 130, 250):
        copy = list(texts[0])
        for i in rng.sample(range(4800), changed):
            copy[i] = word()
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    compared, solved = [], []
    before, before_solved = jaccard._compared, jaccard._solved
    monkeypatch.setattr(jaccard, "_compared", lambda pairs, *a: (compared.extend((r["a"], r["b"]) for r in pairs.select("a", "b").collect()), before(pairs, *a))[1])
    monkeypatch.setattr(jaccard, "_solved", lambda rows, *a: (solved.append(rows.count()), before_solved(rows, *a))[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(spark, texts), 5, 8, 10).collect()}
    assert got == brute_components(list(enumerate(texts)), 5, 8, 10)
    # Five near copies have ten pairs; a text may be asked twice, unrelated ones never.
    assert len({frozenset(x) for x in compared}) <= 10 and not sum(solved)


def test_fine_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    same = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    for own in (0, 100, 900, 6000):
        a, b = (np.concatenate([same[own:], rng.integers(0, 2**64, n, dtype=np.uint64)]) for n in (own, own + 1700))
        x, y = (jaccard._unpacked(jaccard._fine(s)) for s in (a, b))
        size = min(len(x), len(y))
        found = int(np.abs(jaccard._folded(x, size) - jaccard._folded(y, size)).sum(dtype=np.int64))
        assert found <= len(np.setxor1d(a, b))
    assert found * 18 > 2 * (len(a) + len(b))
    assert jaccard._fine(same[:512]) is None


def test_packed_cells_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 50, 3000, 100_000, 2_000_000):
        low, ids = np.sort(rng.integers(0, 2**32, n, dtype=np.uint64)), rng.integers(0, 2**24, n, dtype=np.uint64)
        kind, cells, packed = jaccard._blob(low, ids, 3)
        assert len(cells) <= 4 * n
        if n == 100_000:
            assert len(cells) <= 3 * n
        got = jaccard._unblob(kind, cells, packed, 3)
        assert (got[0] == low).all() and (got[1] == ids).all()
