"""Removal of repeated byte strings by sharded suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
anywhere else in the corpus. Every such window holds a minimiser: the
``GRAM``-byte string of least hash in it. Equal windows have equal minimisers
at equal places, so all windows around one minimiser can be judged in one
shard: it gets, for each place of the minimiser, the bytes around it.

A shard holds for each place the text to its right and, reversed, to its left,
cut into blocks of 32 bytes that are ranked in byte order. Each of the two is
sorted by induced sorting (suffixes classified as smaller or larger, leftmost
smaller substrings sorted recursively, the rest induced in linear passes), and
the permuted common prefixes of neighbours, in blocks and then bytes, part the
order into classes of equal r bytes for any r. A window with l bytes left of
its minimiser is repeated if another place is in its class of l bytes to the
left and of LENGTH - l bytes to the right.

Minimisers that stand at one place only cannot be in a repeated window and
drop out by a pre-aggregated count, before any text moves. Equal texts count
as one text with a multiplicity (all of it is repeated), so copies don't pile
up. A minimiser at more than ``HOT`` places is dealt over shards by text;
what its shards leave open is settled by digests of whole windows, with
pre-aggregation. Texts move to candidates and to the final cut only.

Defined cases: a null text is empty; a text shorter than LENGTH bytes loses
nothing; repeated rows are repeats of each other; ties don't matter; a very
long text is read as a whole by one task, in memory proportional to it, and its
places are dealt over shards like all others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import cut, matched, release, words
from .shingles import buffers, mixed, sliding_least

LENGTH, GRAM, BLOCK = 400, 100, 32
HOT = 50_000
#: A key is frequent from one of so many places on.
OFTEN = 1000
#: Places that a shard sorts at once.
SHARD = 12_000
#: Equal texts that a task remembers, to pass on one of them.
REMEMBERED = 500_000


# ---- induced sorting ------------------------------------------------------


def sais(s) -> list[int]:
    """Suffix array of a sequence of integers that ends with a unique 0."""
    import numpy as np

    s = np.asarray(s, dtype=np.int64)
    n = len(s)
    if n == 1:
        return [0]
    # Types: smaller (1) or larger (0) than the next suffix; equal letters
    # take the type of the next unequal pair.
    nxt = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = np.zeros(n, bool)
    small[-1] = True
    inside = nxt < n - 1
    small[:-1][inside] = s[nxt[inside]] < s[nxt[inside] + 1]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s)
    ends = np.cumsum(sizes)
    letters, types = s.tolist(), small.tolist()

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = ends.tolist()
        for i in reversed(order):
            c = letters[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = (ends - sizes).tolist()
        for i in sa:  # grows ahead of the walk
            j = i - 1
            if i > 0 and not types[j]:
                c = letters[j]
                sa[head[c]] = j
                head[c] += 1
        tail = ends.tolist()
        for at in range(n - 1, -1, -1):
            j = sa[at] - 1
            if j >= 0 and types[j]:
                c = letters[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    order = lms.tolist()
    if len(order) > 1:
        first = np.array(induce(order))
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = first[is_lms[first]]
        stop = np.full(n, n)
        stop[lms[:-1]] = lms[1:] + 1
        stop = stop.tolist()
        names, name, before = [0] * n, 0, None
        for i in ranked.tolist():
            piece = letters[i : stop[i]]
            if piece != before:
                name += 1
                before = piece
            names[i] = name - 1
        reduced = np.array(names)[lms]
        if name < len(order):
            order = lms[np.array(sais(reduced))].tolist()
        else:
            order = lms[np.argsort(reduced)].tolist()
    return induce(order)


def sorted_rows(rows):
    """Order of equally long byte rows by the suffix array of their blocks, and
    for each row but the first the common prefix with the row before it, in
    bytes."""
    import numpy as np

    n, width = rows.shape
    per = -(-width // BLOCK)
    padded = np.zeros((n, per * BLOCK), np.uint8)
    padded[:, :width] = rows
    blocks = np.unique(padded.reshape(n * per, BLOCK).view(f"S{BLOCK}").ravel(), return_inverse=True)[1].reshape(n, per)
    text = np.ones((n, per + 1), np.int64)
    text[:, :per] = blocks + 2
    sa = np.array(sais(np.concatenate([text.ravel(), [0]])))
    order = sa[(sa % (per + 1) == 0) & (sa < n * (per + 1))] // (per + 1)
    # Permuted: by place in the text, each row against its predecessor.
    phi = np.full(n, -1)
    phi[order[1:]] = order[:-1]
    at = np.flatnonzero(phi >= 0)
    differ = blocks[at] != blocks[phi[at]]
    whole = np.where(differ.any(1), differ.argmax(1), per)
    common = np.full(n, -1)
    common[at] = whole * BLOCK
    part = at[whole < per]
    column = whole[whole < per][:, None] * BLOCK + np.arange(BLOCK)
    unequal = padded[part[:, None], column] != padded[phi[part][:, None], column]
    common[part] += unequal.argmax(1)
    return order, common[order]


def repeated_windows(right, left, low, high):
    """For each place, the l for which its window is repeated, as a matrix of
    booleans [place, l]; low and high bound the l of each place."""
    import numpy as np

    n, most = len(low), int(high.max(initial=-1)) + 1
    out = np.zeros((n, most), bool)
    if n < 2:
        return out
    order_r, common_r = sorted_rows(right)
    order_l, common_l = sorted_rows(left) if left.shape[1] else (np.arange(n), np.zeros(n, np.int64))
    of_r, of_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for length in range(int(low.min()), most):
        at = np.flatnonzero((low <= length) & (length <= high))
        if len(at) < 2:
            continue
        of_r[order_r] = np.cumsum(common_r < LENGTH - length)
        of_l[order_l] = np.cumsum(common_l < length)
        key = of_r[at] * (n + 1) + of_l[at]
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        out[at[count[where] > 1], length] = True
    return out


# ---- minimisers -----------------------------------------------------------


def _gram_hashes(raw):
    """Mixed hash of each GRAM bytes of a text, by a wrapping polynomial."""
    import numpy as np

    from .shingles import _powers

    forth, back = _powers(len(raw) + 1, 2)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_values()[raw] * forth[: len(raw)], out=sums[1:])
        return mixed((sums[GRAM:] - sums[:-GRAM]) * back[: len(raw) - GRAM + 1])


@cache
def _byte_values():
    import numpy as np

    return np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)


def minimisers(raw):
    """Places of the minimisers of a text, their hashes, and the least and most
    bytes that the windows they stand for have to their left."""
    import numpy as np

    if len(raw) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    g = _gram_hashes(raw)
    width, n = LENGTH - GRAM + 1, len(g)
    least, starts = sliding_least(g, width), np.arange(n - width + 1)
    # Leftmost place of the least: the first place with that hash from the start on.
    equal = np.flatnonzero(np.isin(g, least)) if len(least) else starts
    codes = g[equal]
    names, code = np.unique(codes, return_inverse=True)
    want = np.searchsorted(names, least)
    by = np.lexsort((equal, code))
    at = np.searchsorted(code[by] * np.int64(n + 1) + equal[by], want * np.int64(n + 1) + starts)
    place = equal[by][at]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([new[1:], [len(place)]]) - 1
    return place[new], g[place[new]], place[new] - starts[last], place[new] - starts[new]


def _minimisers(rows: DataFrame) -> DataFrame:
    """(key, tid, pos, low, high) for rows of (tid, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen: set = set()
        names = ["key", "tid", "pos", "low", "high"]
        for batch in batches:
            raw, at = buffers(batch.column(1))
            parts, size = [], 0
            for i, tid in enumerate(batch.column(0).to_pylist()):
                if at[i + 1] - at[i] < LENGTH or tid in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(tid)
                place, key, low, high = minimisers(raw[at[i] : at[i + 1]])
                parts.append((key.view(np.int64), np.full(len(place), tid), place, low, high))
                size += len(place)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), kinds())], names)
                    parts, size = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), kinds())], names)

    def kinds():
        import pyarrow as pa

        return pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16()

    return rows.mapInArrow(run, "key long, tid long, pos int, low short, high short")


_PLACE = "key long, salt int, tid long, base int, piece binary, at array<int>, low array<int>, high array<int>"


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of text around the places of each key, for rows of (tid, text,
    places); places of one key that are near share a piece."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 3]
        names = [c.split()[0] for c in _PLACE.split(", ")]
        for batch in batches:
            raw, at = buffers(batch.column(1))
            out, held = [], 0
            for i, (tid, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = raw[at[i] : at[i + 1]]
                group: list = []
                for p in [*sorted((p["key"], p["salt"], p["pos"], p["low"], p["high"]) for p in places), None]:
                    if group and (p is None or p[:2] != group[-1][:2] or p[2] - p[4] > group[-1][2] + LENGTH):
                        base = min(g[2] - g[4] for g in group)
                        piece = text[base : max(g[2] - g[3] + LENGTH for g in group)].tobytes()
                        out.append((group[0][0], group[0][1], tid, base, piece, [g[2] - base for g in group], [g[3] for g in group], [g[4] for g in group]))
                        held += len(piece)
                        group = []
                    if p is not None and (not group or p != group[-1]):
                        group.append(p)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, _PLACE)


def _settled(pieces: DataFrame) -> DataFrame:
    """(tid, start, stop, open): runs of window starts; open is null for
    repeated windows, and a digest for windows of salted keys that are single
    in their shard (start = stop)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["tid", "start", "stop", "open1", "open2"]

        def solve(rows):
            most = LENGTH - GRAM
            tid = np.concatenate([np.full(len(r[5]), r[2]) for r in rows])
            place = np.concatenate([np.array(r[5]) + r[3] for r in rows])
            low, high = (np.concatenate([np.array(r[c]) for r in rows]) for c in (6, 7))
            salted = np.concatenate([np.full(len(r[5]), r[1] > 0) for r in rows])
            right, left = np.zeros((len(tid), LENGTH), np.uint8), np.zeros((len(tid), most), np.uint8)
            i = 0
            for r in rows:
                piece = np.frombuffer(r[4], np.uint8)
                for at in r[5]:
                    own = piece[at : at + LENGTH]
                    right[i, : len(own)] = own
                    back = piece[max(0, at - most) : at][::-1]
                    left[i, : len(back)] = back
                    i += 1
            # One place of one text may come twice (copies in several tasks).
            _, first = np.unique(np.stack([tid, place]), axis=1, return_index=True)
            tid, place, low, high, salted, right, left = (x[first] for x in (tid, place, low, high, salted, right, left))
            hit = repeated_windows(right, left, low, high)
            # Bytes left of the minimiser fall as the start rises.
            edge = np.zeros((len(tid), hit.shape[1] + 2), np.int8)
            edge[:, 1:-1] = hit
            step = np.diff(edge, axis=1)
            up, down = np.nonzero(step == 1), np.nonzero(step == -1)
            cols = [tid[up[0]], place[up[0]] - (down[1] - 1), place[up[0]] - up[1]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], pa.nulls(len(up[0]), pa.int64()), pa.nulls(len(up[0]), pa.int64())], names)
            rest = []
            for j in np.flatnonzero(salted).tolist():
                for x in range(low[j], high[j] + 1):
                    if not hit[j, x]:
                        d = hashlib.blake2b(left[j, :x][::-1].tobytes() + right[j, : LENGTH - x].tobytes(), digest_size=16).digest()
                        rest.append((tid[j], place[j] - x, place[j] - x, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names)
            # Of a salted key's classes that are settled here, one window each
            # stands for the class elsewhere.
            if salted.any():
                stand: dict = {}
                for j in np.flatnonzero(salted).tolist():
                    for x in np.flatnonzero(hit[j]).tolist():
                        d = hashlib.blake2b(left[j, :x][::-1].tobytes() + right[j, : LENGTH - x].tobytes(), digest_size=16).digest()
                        stand[d] = (tid[j], place[j] - x)
                rest = [(t, s, s, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) for d, (t, s) in stand.items()]
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names)

        held: list = []
        size, key = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SHARD and row[:2] != key:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                key = row[:2]
        if held:
            yield from solve(held)

    dealt = pieces.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.mapInArrow(run, "tid long, start int, stop int, open1 long, open2 long")


def identity(seed: int):
    """A hash of a text, and another one that tells whether two differ."""
    return F.xxhash64(F.lit(seed), F.col("text")), F.xxhash64(F.lit(-seed), F.col("text"))


def named(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc, text, tid) and (tid, doc, copies) of every text of ``least`` bytes
    or more, and the seed of tid, a hash of the text. Two texts with one tid
    are told apart by a second hash; then another seed is taken."""
    text = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc"), "text").where(F.octet_length("text") >= least)
    seed = 1
    while True:
        tid, check = identity(seed)
        rows = text.select("doc", tid.alias("tid"), check.alias("c"))
        texts = cut(rows.groupBy("tid").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.min("c").alias("low"), F.max("c").alias("high")), "texts")
        if not texts.where("low <> high").limit(1).count():
            break
        release(texts)
        seed += 1
    return text.withColumn("tid", identity(seed)[0]), texts, seed


def spans(text: DataFrame, texts: DataFrame) -> DataFrame:
    """(tid, starts): runs of starts of repeated windows of each text that is
    not repeated as a whole, for what ``named`` gives."""
    text = text.where(F.octet_length("text") >= LENGTH)
    found = cut(_minimisers(text.select("tid", "text")), "minimisers")
    place = F.xxhash64("tid", "pos")
    keys = found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b")
    keys = cut(keys.select("key", "n", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "keys")
    kept = matched(found, keys, ["key"], OFTEN)
    salt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("tid", F.lit(7)), F.col("parts")).cast("int") + 1).otherwise(0)
    kept = kept.select("tid", F.struct("key", salt.alias("salt"), "pos", "low", "high").alias("p")).groupBy("tid").agg(F.collect_list("p").alias("places"))
    kept = kept.join(texts.select("tid", "doc"), "tid")
    pieces = _pieces(text.join(kept, ["doc", "tid"]).select("tid", "text", "places"))
    settled = cut(_settled(pieces), "settled")
    release(found, keys)
    closed = settled.where("open1 is null").select("tid", "start", "stop")
    still = settled.where("open1 is not null")
    where = F.xxhash64("tid", "start")
    twice = still.groupBy("open1", "open2").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("open1", "open2")
    closed = closed.unionByName(still.join(twice, ["open1", "open2"]).select("tid", "start", "stop"))
    return closed.groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("starts"))


def deduplicated(docs: DataFrame, shared: bool = False) -> DataFrame:
    """doc_id, n_bytes, removed (runs of removed bytes as (from, to)), kept,
    shared: whether the text has a passage of another document (see passages;
    false unless asked for)."""
    least = min(LENGTH, passages.LEAST) if shared else LENGTH
    text, texts, seed = named(docs, least)
    found = spans(text, texts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tid", F.when(F.octet_length("text") >= least, identity(seed)[0]))
    marks = texts.where("copies > 1").select("tid", F.lit(True).alias("whole")).join(found, "tid", "full")
    if shared:
        marks = marks.join(passages.shared(text, texts, OFTEN).withColumn("shared", F.lit(True)), "tid", "full")
    rows = rows.join(marks, "tid", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    passage = F.coalesce(F.col("shared"), F.col("whole") & (F.size(words(F.col("text"))) >= passages.WORDS)) if shared else F.lit(False)
    rows = rows.select("doc_id", "text", (F.col("whole") & (F.octet_length("text") >= LENGTH)).alias("whole"), "starts", passage.alias("shared"))

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "removed", "kept", "shared"]
        run_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            raw, at = buffers(batch.column(1))
            runs_of, kept, size = [], [], []
            for i, (whole, starts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                text = raw[at[i] : at[i + 1]].tobytes()
                runs: list = [[0, len(text)]] if whole else []
                for s in sorted((x["start"], x["stop"]) for x in starts or []) if not whole else []:
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1] + LENGTH)
                    else:
                        runs.append([s[0], s[1] + LENGTH])
                out, end = [], 0
                for a, b in runs:
                    out.append(text[end:a])
                    end = b
                kept.append(b"".join([*out, text[end:]]))
                runs_of.append([{"start": a, "stop": b} for a, b in runs])
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(runs_of, run_type), pa.array(kept, pa.binary()), batch.column(4)], names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary, shared boolean")


def _report(rows: DataFrame, *more) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("removed") > 0).alias("has_repeats"), *more)


def dedup_report(docs: DataFrame) -> DataFrame:
    """The contract's view: sizes, runs and digest of what is kept; besides,
    whether anything of the text repeats."""
    return _report(deduplicated(docs))


def passage_report(docs: DataFrame) -> DataFrame:
    """dedup_report, and whether the text has a passage of over 50 words of
    another document, which can be shorter than LENGTH bytes and then stays."""
    return _report(deduplicated(docs, shared=True), F.col("shared").alias("has_shared_passage"))
