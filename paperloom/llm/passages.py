"""Texts that share a passage of over 50 words with another text.

A passage is ``WORDS`` words in a row, whatever white space and case (A-Z) they
stand in. Each such window holds a minimiser, the ``GRAM`` words of least hash
in it; equal windows have equal ones. Minimisers of one text only drop out by a
pre-aggregated count, before any text moves. The windows of the others are told
apart by 128-bit hashes, also pre-aggregated; hashes that are frequent go with
the tasks.

Defined cases: a null text or one of fewer words shares nothing; what a text
repeats of itself doesn't count; a very long text is read whole by one task; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, matched, release
from .shingles import _powers, chunks, mixed, sliding_least, word_hashes

WORDS, GRAM = 51, 12
#: Bytes that so many words take at least.
LEAST = 2 * WORDS - 1


def _sums(hashes, width: int, seed: int):
    """Mixed hash of each ``width`` words, by a wrapping polynomial."""
    import numpy as np

    forth, back = _powers(len(hashes) + 1, seed)
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * forth[: len(hashes)], out=sums[1:])
        return mixed((sums[width:] - sums[:-width]) * back[:n])


def _windows(raw, at):
    """Word hashes, and of each window within a row its first word, its row and
    the hash of its minimiser."""
    import numpy as np

    hashes, row = word_hashes(raw, at)
    if len(hashes) < WORDS:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_least(_sums(hashes, GRAM, 2), WORDS - GRAM + 1)
    start = np.flatnonzero(row[: len(least)] == row[WORDS - 1 :])
    return hashes, start, row[start], least[start]


def _keys(rows: DataFrame) -> DataFrame:
    """(key, tid) for rows of (tid, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tid = batch.column(0).to_numpy(zero_copy_only=False)
            for i, raw, at in chunks(batch.column(1)):
                _, _, row, key = _windows(raw, at)
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(tid[i + row[new]])], ["key", "tid"])

    return rows.mapInArrow(run, "key long, tid long")


def _candidates(rows: DataFrame) -> DataFrame:
    """(tid, w1, w2) of the windows around some keys, for rows of (tid, text,
    keys)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tid = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            held = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(len(tid)), lists.value_lengths().to_numpy(zero_copy_only=False))
            for i, raw, at in chunks(batch.column(1)):
                hashes, start, row, key = _windows(raw, at)
                with np.errstate(over="ignore"):
                    named = lambda k, r: mixed(k + mixed(r.astype(np.uint64) + np.uint64(1)))
                    mine = (of >= i) & (of < i + len(at) - 1)
                    take = np.isin(named(key, row), named(held[mine], of[mine] - i))
                start, row = start[take], row[take]
                if not len(start):
                    continue
                w = np.stack([row.view(np.uint64), _sums(hashes, WORDS, 3)[start], _sums(hashes, WORDS, 4)[start]], axis=1)
                w = w[np.lexsort(w.T[::-1])]
                w = w[np.concatenate([[True], (w[1:] != w[:-1]).any(1)])].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tid[i + w[:, 0]]), pa.array(w[:, 1].copy()), pa.array(w[:, 2].copy())], ["tid", "w1", "w2"])

    return rows.mapInArrow(run, "tid long, w1 long, w2 long")


def _of_several(rows: DataFrame, on: list[str]) -> DataFrame:
    """What stands in several texts, and how often."""
    seen = rows.groupBy(*on).agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count("*").alias("n"))
    return cut(seen.where("a <> b").select(*on, "n"), "several")


def shared(text: DataFrame, texts: DataFrame, often: int) -> DataFrame:
    """tid of each text that has a window of another, for (doc, tid, text) and
    (tid, doc), one row a text."""
    found = cut(_keys(text.select("tid", "text")), "passage_keys")
    keys = _of_several(found, ["key"])
    kept = matched(found, keys, ["key"], often).groupBy("tid").agg(F.collect_set("key").alias("keys")).join(texts.select("tid", "doc"), "tid")
    windows = cut(_candidates(text.join(kept, ["doc", "tid"]).select("tid", "text", "keys")), "windows")
    release(found, keys)
    several = _of_several(windows, ["w1", "w2"])
    out = cut(matched(windows, several, ["w1", "w2"], often).select("tid").distinct(), "passages")
    release(windows, several)
    return out
