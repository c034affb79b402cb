"""Exact Jaccard join of shingle sets in metric space.

Points are the different shingle sets of the corpus, the metric is the Jaccard
distance (symmetric difference over union). Regions form in three steps, each
by the triangle inequality:

1. Pivot: the empty set. A set's distance to it is its size (in symmetric
   difference), so shells of sizes are regions, and a set joins the next shell
   too if a partner can be in it (the window over the border).
2. Pivots: the projections of a set on k ranges of hashes. Two sets of a shell
   with at most h different shingles agree on at least k - h of its ranges;
   sets with the same projection are a Voronoi cell of radius 0. k leaves room
   for ranges in which a set is empty, so empty cells never count; a set with
   more of them is projected again with other hashes.
3. Pivots: documents. A cell with more than ``CELL`` sets takes its least
   member as pivot. Members within the radius are linked to it and, being in
   one component, need not meet each other. A member u outside can only link
   to v inside if d(v, p) >= d(u, p) - radius; such v stay with the members
   outside (the window). Up to ``LOCAL`` of them are solved in one task, by
   components; more form regions anew, recursively.

Document pivots come last because unrelated texts all lie at a distance near
1 from any document: at the top their windows would hold every document.

Candidates meet a lower bound of their symmetric difference before their texts
are compared: from 128 counts, then, as these come out alike for any two long
texts, from a count for every two to four shingles. Of candidates only those
that would still join two components are compared. No pair is dropped
otherwise, none is capped. A member that this bound keeps from its pivot needs
no exact distance: the bound stands for it, which only widens the window.

Distribution: a set costs about 0.1 (similarity 0.9) to 0.25 (0.8) numbers of
16 bytes a shingle in one shuffle. Copies of a text count once. Cells are read
as sorted streams, so a cell takes constant memory whatever its size. Texts
move only to candidates. Rounds are cut to tables in the shared folder.

Defined cases: a null or empty text has no shingles and is linked with
nothing; rows of one doc_id count as one document for links, whatever their
texts; a null doc_id has no component and takes no part; ties don't matter;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, as_few, cut, few, give_back, release, tidy_driver
from .components import components
from .shingles import chunks, mixed, sets

#: Cells up to so many sets are compared pair by pair.
CELL = 8
#: New projections of a set with too many empty ranges, before single shingles.
TRIES = 5
SKETCH = 128
#: Shingles a count of a fine sketch, counts of it at most, and largest count.
FINE, MOST_FINE, TOP = 4, 1 << 15, 15
#: Regions up to so many sets are solved in one task.
LOCAL = 2048
#: Rounds that take only the largest cell of each member.
TURNS = 2
#: Open pairs a member of a region that are compared one by one.
PAIRS = 4
#: Texts that are compared in one task, and most whose regions are united.
GROUP, CLUSTER = 512, 20_000
#: Regions that a task packs at once, and that a part holds.
BUFFER, PART = 1_000_000, 1_000_000
#: Copies of a text that a task remembers, to pass on one of them.
REMEMBERED = 500_000


@cache
def shells(p: int, q: int) -> list[tuple[int, int, int, int]]:
    """Shells of sizes for similarity p / q: (least, most, k, spare)."""
    import math

    out, least = [], -(-q // (q - p))
    grow = max(1.3, 1.02 * q / p)
    while least < 1 << 40:
        most = int(least * grow)
        h = 2 * most * (q - p) // (q + p)
        spare = 1
        for _ in range(4):
            k = h + 1 + spare
            empty = k * math.exp(-(least + most) / 2 / k)
            spare = min(math.ceil(empty + 2 * math.sqrt(empty)), max(1, (h + 1) // 6))
        out.append((least, most, h + 1 + spare, spare))
        least = most + 1
    return out


def _cells(flat, at, ids, space, p: int, q: int, level: int):
    """(cell, id) of each set and each region it belongs to."""
    import numpy as np

    u64 = np.uint64
    table = shells(p, q)
    lows = np.array([s[0] for s in table])
    n = np.diff(at)
    own = np.searchsorted(lows, n, "right") - 1
    following = np.minimum(own + 1, len(table) - 1)
    out_cell, out_id = [], []
    with np.errstate(over="ignore"):
        for member, shell in ((np.flatnonzero(own >= 0), own), (np.flatnonzero((n > 0) & (n * q >= lows[following] * p)), following)):
            for turn in range(TRIES + 1):
                if not len(member):
                    break
                size, cls = n[member], shell[member]
                row = np.repeat(np.arange(len(member)), size)
                values = flat[np.repeat(at[member] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                salt = u64(level * (TRIES + 1) + turn)
                tag = mixed(space[member] * u64(0x9E3779B97F4A7C15) + cls.astype(u64) * u64(0xC2B2AE3D27D4EB4F) + salt)
                if salt:
                    values = mixed(values + salt * u64(0xA0761D6478BD642F))
                if turn == TRIES:
                    order = np.lexsort((values, row))
                    row, values = row[order], values[order]
                    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                    keep = place <= (size - -(-size * p // q))[row]
                    out_cell.append(mixed(values[keep] + tag[row[keep]]))
                    out_id.append(ids[member][row[keep]])
                    break
                k = np.array([s[2] for s in table])[cls]
                spare = np.array([s[3] for s in table])[cls]
                part = (((values >> u64(32)) * k[row].astype(u64)) >> u64(32)).astype(np.int64)
                if salt:
                    order = np.lexsort((part, row))
                    row, part, values = row[order], part[order], values[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
                start = np.flatnonzero(new)
                total = np.add.reduceat(mixed(values ^ u64(0xE7037ED1A0B428DB)), start)
                out_cell.append(mixed(total + mixed(tag[row[start]] + part[start].astype(u64) * u64(0x8EBC6AF09C88C6E3))))
                out_id.append(ids[member][row[start]])
                empty = k - np.bincount(row[start], minlength=len(member))
                member = member[empty > spare]
    if not out_cell:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_cell).view(np.int64), np.concatenate(out_id).view(np.int64)


def _digests(flat, at):
    """Two 64-bit digests of each set."""
    import numpy as np

    out = []
    with np.errstate(over="ignore"):
        for salt in (0x589965CC75374CC3, 0x1D8E4E27C47D124F):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat ^ np.uint64(salt)))])
            out.append(mixed(sums[at[1:]] - sums[at[:-1]] + np.uint64(salt)))
    return out


def _fine(values) -> bytes | None:
    """Counts of a set's hashes by their lower bits, two to a byte; None where
    a sketch of SKETCH counts is as fine. Counts above TOP are TOP."""
    import numpy as np

    size = SKETCH
    while size < MOST_FINE and size * FINE < len(values):
        size *= 2
    if size == SKETCH:
        return None
    x = np.minimum(np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size), TOP).astype(np.uint8)
    return (x[0::2] | x[1::2] << 4).tobytes()


def _unpacked(fine: bytes):
    import numpy as np

    raw = np.frombuffer(fine, np.uint8)
    out = np.empty(2 * len(raw), np.int8)
    out[0::2], out[1::2] = raw & 15, raw >> 4
    return out


def _folded(x, size: int):
    """The fine sketch of ``size`` counts of the set whose fine sketch is x."""
    import numpy as np

    while len(x) > size:
        x = np.minimum(x[: len(x) // 2] + x[len(x) // 2 :], TOP).astype(np.int8)
    return x


def profiles(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, n (shingles), id and check (digests of the set), sketch, fine."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, raw, at in chunks(batch.column(1)):
                flat, to = sets(raw, at, width, seed)
                rows, n = len(at) - 1, np.diff(to)
                a, b = _digests(flat, to)
                counts = np.bincount(np.repeat(np.arange(rows), n) * SKETCH + (flat & np.uint64(SKETCH - 1)).astype(np.int64), minlength=rows * SKETCH)
                sketch = np.minimum(counts, 255).astype(np.uint8).reshape(rows, SKETCH)
                fine = [_fine(flat[s:e]) for s, e in zip(to[:-1].tolist(), to[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(fine, pa.binary())], ["doc_id", "n", "id", "check", "sketch", "fine"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, id long, check long, sketch binary, fine binary")


def _blob(low, ids, width: int):
    """Sorted 32-bit cells as differences (two bytes each, FFFF for 65535 more,
    or three bytes) where that is shorter, and the low ``width`` bytes of the
    ids."""
    import numpy as np

    step = np.diff(low, prepend=low.dtype.type(0))
    more = (step // 65535).astype(np.int64)
    kind, cells = 1, low.astype("<u4").tobytes()
    if len(low) < 2 * more.sum() and step.max() < 1 << 24:
        kind, cells = 3, step.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    elif more.sum() < len(low):
        out = np.full(len(low) + int(more.sum()), 0xFFFF, "<u2")
        out[np.arange(len(low)) + np.cumsum(more)] = step % 65535
        kind, cells = 0, out.tobytes()
    return kind, cells, ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unblob(kind: int, cells: bytes, ids: bytes, width: int):
    import numpy as np

    if kind == 0:
        step = np.frombuffer(cells, "<u2")
        low = np.cumsum(step, dtype=np.uint64)[step != 0xFFFF]
    elif kind == 3:
        step = np.zeros((len(cells) // 3, 4), np.uint8)
        step[:, :3] = np.frombuffer(cells, np.uint8).reshape(-1, 3)
        low = np.cumsum(step.view("<u4").ravel(), dtype=np.uint64)
    else:
        low = np.frombuffer(cells, "<u4" if kind == 1 else "<u8").astype(np.uint64)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :width] = np.frombuffer(ids, np.uint8).reshape(-1, width)
    return low, wide.view("<u8").ravel()


def _regions(rows: DataFrame, width: int, seed: int, p: int, q: int, level: int, parts: int, short: int) -> DataFrame:
    """Regions of the texts of (space, text), packed: (part, kind, cells, ids).

    Cells are dealt over ``parts`` parts by their upper half; a row holds the
    sorted lower halves of one part's cells and ``short`` bytes of each id. Of a
    cell with more than CELL members in one task's buffer the others go to any
    part as whole numbers (kind 2), so that no part gets a large cell whole."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["part", "kind", "cells", "ids"]
        held: list = []
        size, turns = 0, 0

        def flush():
            nonlocal size, turns
            cell, of = (np.concatenate(c).view(np.uint64) for c in zip(*held))
            held.clear()
            size, turns = 0, turns + 1
            key = ((cell >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)) << np.uint64(32) | cell & np.uint64(0xFFFFFFFF)
            del cell
            order = np.argsort(key)
            key, of = key[order], of[order]
            del order
            over = np.zeros(len(key), bool)
            over[CELL + 1 :] = key[CELL + 1 :] == key[: -CELL - 1]
            out = []
            if over.any():
                out.append((int(mixed(of[over][:1])[0] % np.uint64(parts)), 2, key[over].astype("<u8").tobytes(), of[over].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :short].tobytes()))
                key, of = key[~over], of[~over]
            part = (key >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                out.append((int(part[s]), *_blob(key[s:e] & np.uint64(0xFFFFFFFF), of[s:e], short)))
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64]), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names)

        seen: set = set()
        for batch in batches:
            spaces = batch.column(0).to_numpy().view(np.uint64)
            for i, raw, at in chunks(batch.column(1)):
                flat, to = sets(raw, at, width, seed)
                ids = _digests(flat, to)[0]
                space = spaces[i : i + len(ids)]
                first = np.zeros(len(ids), bool)
                for j, key in enumerate(zip(space.tolist(), ids.tolist())):
                    if key not in seen:
                        first[j] = True
                        seen.add(key)
                if len(seen) > REMEMBERED:
                    seen.clear()
                n = np.diff(to)
                keep = np.repeat(first, n)
                to = np.concatenate([[0], np.cumsum(n[first])])
                cell, of = _cells(flat[keep], to, ids[first], space[first], p, q, level)
                if len(cell):
                    held.append((cell, of))
                    size += len(cell)
                    if size >= BUFFER:
                        yield from flush()
                        give_back()
        if held:
            yield from flush()
        give_back()

    return rows.mapInArrow(run, "part int, kind int, cells binary, ids binary")


def _candidates(regions: DataFrame, short: int) -> DataFrame:
    """(cell, a, b) from packed regions: pairs of small cells without cell;
    members a of crowded cells without b. a and b are shortened ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["cell", "a", "b"]

        def solve(part, packed):
            """Members of one part's cells; most cells have one and go first."""
            low, ids = (np.concatenate(c) for c in zip(*packed))
            packed.clear()
            order = np.argsort(low)
            low = low[order]
            meets = np.zeros(len(low), bool)
            meets[1:] = low[1:] == low[:-1]
            meets[:-1] |= meets[1:]
            low, ids = low[meets], ids[order[meets]]
            del order, meets
            order = np.lexsort((ids, low))
            low, ids = low[order], ids[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])
            low, ids = low[new].astype(np.uint64), ids[new]
            starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
            lens = np.diff(np.concatenate([starts, [len(low)]]))
            many = np.repeat(lens > CELL, lens)
            if many.any():
                cell = (low[many] | np.uint64(part) << np.uint64(32)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[many].view(np.int64)), pa.nulls(len(cell), pa.int64())], names)
            # Near copies share most of their cells, so a pair comes many times.
            a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            for j in range(1, min(CELL, len(low))):
                at = np.flatnonzero((low[j:] == low[:-j]) & ~many[j:])
                if not len(at):
                    break
                a, b = np.concatenate([a, ids[at + j]]), np.concatenate([b, ids[at]])
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                a, b = a[new], b[new]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

        held: list = []
        now = None
        for batch in batches:
            for part, kind, cells, ids in zip(*(batch.column(i) for i in range(4))):
                part, kind = part.as_py(), kind.as_py()
                low, of = _unblob(kind, cells.as_buffer(), ids.as_buffer(), short)
                if kind == 2:
                    yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(of.view(np.int64)), pa.nulls(len(of), pa.int64())], names)
                    continue
                if part != now and held:
                    yield from solve(now, held)
                    give_back()
                now = part
                held.append((low.astype(np.uint32), of))
        if held:
            yield from solve(now, held)
        give_back()

    dealt = regions.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "cell long, a long, b long")


def _near(pairs: DataFrame, sets_of: DataFrame, p: int, q: int) -> DataFrame:
    """The sets (a, b) of pairs (x, y) of short ids whose sizes and sketches
    allow a link."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, SKETCH).astype(np.int16) for c in (2, 3))
            apart, most = np.abs(x - y).sum(1, dtype=np.int64), batch.column(4).to_numpy()
            keep = pa.array(apart * (q + p) <= most * (q - p))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = sets_of.select(F.col("short").alias("x"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sets_of.select(F.col("short").alias("y"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(left, "x").join(right, "y").where(F.least("na", "nb") * q >= F.greatest("na", "nb") * p).where("a <> b")
    return rows.select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("most")).mapInArrow(run, "a long, b long")


def _grouped(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the group ``g`` in which they are compared. Texts
    with one least neighbour meet in one group, small ones several to a group,
    large ones in blocks of ``GROUP`` against blocks, so that a text moves once
    for each block that it meets and not for each pair."""
    n_pairs = pairs.count()
    if n_pairs <= GROUP:
        return pairs.select(F.lit(0).cast("long").alias("g"), "a", "b")
    one = F.broadcast if n_pairs <= FEW else lambda df: df  # as few() does
    pairs = pairs.coalesce(1) if n_pairs <= FEW else pairs
    near = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
    hub = near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("hub"))
    of = pairs.join(one(hub.withColumnRenamed("id", "b")), "b")
    # The number of texts only sizes the blocks, so an estimate will do.
    sizes = of.groupBy("hub").agg(F.count("*").alias("pairs"), F.approx_count_distinct("a").alias("texts"))
    n = F.ceil((F.col("texts") + 1) / GROUP)
    i, j = (F.pmod(F.xxhash64(c, F.lit(5)), n) for c in ("a", "b"))
    own = F.xxhash64("hub", i, j)
    packs = max(1, n_pairs // (4 * GROUP))
    out = of.join(one(sizes), "hub").select(F.when(F.col("pairs") > 4 * GROUP, own).otherwise(F.pmod(F.xxhash64("hub"), F.lit(packs))).alias("g"), "a", "b")
    return few(cut(out, "grouped"))


def _bounded(pairs: DataFrame, sets_of: DataFrame) -> DataFrame:
    """(a, b, apart, most) of pairs grouped by ``g``: a lower bound of the
    symmetric difference, from fine sketches where both have them, and the sum
    of the sizes."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        names = ["a", "b", "apart", "most"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        at = {x: i for i, x in enumerate(right["id"].to_pylist())}
        n, coarse, packed = (right[c].to_pylist() for c in ("n", "sketch", "fine"))
        fine = [_unpacked(x) if x else None for x in packed]
        done = []
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist()):
            i, j = at[a], at[b]
            if fine[i] is None or fine[j] is None:
                x, y = (np.frombuffer(coarse[k], np.uint8).astype(np.int16) for k in (i, j))
            else:
                size = min(len(fine[i]), len(fine[j]))
                x, y = _folded(fine[i], size), _folded(fine[j], size)
            done.append((a, b, int(np.abs(x - y).sum(dtype=np.int64)), n[i] + n[j]))
        return pa.table({c: pa.array(list(x), pa.int64()) for c, x in zip(names, zip(*done))})

    members = pairs.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().join(sets_of.select("id", "n", "sketch", "fine"), "id").select("g", "id", "n", "sketch", "fine")
    asked = pairs.select(F.col("g").alias("h"), "a", "b")
    return asked.groupBy("h").cogroup(members.groupBy("g")).applyInArrow(run, "a long, b long, apart long, most long")


def _compared(pairs: DataFrame, texts: DataFrame, width: int, seed: int, p: int, q: int, links: bool) -> DataFrame:
    """(a, b, shared, whole): sizes of intersection and union of pairs grouped
    by ``g``; with ``links`` only of those that link two texts which the links
    found in the group before don't connect."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        names = ["a", "b", "shared", "whole"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        right = right.combine_chunks()
        at, parts = {x: i for i, x in enumerate(right["id"].to_pylist())}, []
        for _, raw, to in chunks(right["text"].chunk(0)):
            flat, ends = sets(raw, to, width, seed)
            parts += [flat[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
        root = list(range(len(parts)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        done = []
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist()):
            if a not in at or b not in at:
                continue
            i, j = at[a], at[b]
            if links and find(i) == find(j):
                continue
            both = len(np.intersect1d(parts[i], parts[j], assume_unique=True))
            whole = len(parts[i]) + len(parts[j]) - both
            if not links or both * q >= whole * p:
                done.append((a, b, both, whole))
                root[find(i)] = find(j)
        cols = zip(*done) if done else ((), (), (), ())
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(names, cols)})

    members = pairs.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id").select("g", "id", "text")
    asked = pairs.select(F.col("g").alias("h"), "a", "b")
    return asked.groupBy("h").cogroup(members.groupBy("g")).applyInArrow(run, "a long, b long, shared long, whole long")


def _paired(rows: DataFrame, p: int, q: int) -> DataFrame:
    """(cell, a, b) for regions of (cell, id, root, side, n, sketch, fine): pairs
    of two components (and, where the region has two sides, of the two sides)
    whose sizes and sketches allow a link; where ``fine`` is null the sketch
    alone decides. A region with more than ``PAIRS`` of them a member gives its
    members instead, without b. Regions are read as sorted streams."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solve(cell, ids, root, side, n, sketch, packed):
            rows = len(ids)
            two = side.min() != side.max()
            level = np.array([2 * len(x) if x else 0 for x in packed])
            finer: dict = {}

            def fine_of(size):
                """Sketches of ``size`` counts of all members that meet at it."""
                if size not in finer:
                    of = np.flatnonzero((level == size) | (level == 2 * size))
                    where = np.full(rows, -1)
                    where[of] = np.arange(len(of))
                    finer[size] = where, np.stack([_folded(_unpacked(packed[k]), size) for k in of.tolist()])
                return finer[size]

            def allowed(i, j):
                """Those of the pairs (i, j) that sketches leave open."""
                near = (root[j] != root[i]) & (np.minimum(n[j], n[i]) * q >= np.maximum(n[j], n[i]) * p)
                if two:
                    near &= side[j] != side[i]
                i, j = i[near], j[near]
                near = np.abs(sketch[j] - sketch[i]).sum(1, dtype=np.int64) * (q + p) <= (n[j] + n[i]) * (q - p)
                i, j = i[near], j[near]
                least, most = np.minimum(level[i], level[j]), np.maximum(level[i], level[j])
                close = (least > 0) & (most <= 2 * least)
                open_ones = np.ones(len(i), bool)
                for size in np.unique(least[close]).tolist():
                    where, sketches = fine_of(size)
                    of = np.flatnonzero(close & (least == size))
                    step = max(1, (1 << 22) // size)
                    for s in range(0, len(of), step):
                        k = of[s : s + step]
                        apart = np.abs(sketches[where[j[k]]] - sketches[where[i[k]]]).sum(1, dtype=np.int64)
                        open_ones[k] = apart * (q + p) <= (n[j[k]] + n[i[k]]) * (q - p)
                return i[open_ones], j[open_ones]

            found, total = [], 0
            member = np.zeros(rows, bool)
            if rows <= 64:
                asked = [np.triu_indices(rows, 1)]
            else:
                asked = ((np.full(rows - 1 - i, i), np.arange(i + 1, rows)) for i in range(rows - 1))
            for i, j in asked:
                i, j = allowed(i, j)
                if len(i):
                    member[i] = member[j] = True
                    total += len(i)
                    if total <= PAIRS * rows:
                        found.append((ids[i], ids[j]))
            if total > PAIRS * rows:
                a = ids[member]
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), cell)), pa.array(a), pa.nulls(len(a), pa.int64())], ["cell", "a", "b"])
            if not found:
                return None
            a, b = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), cell)), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["cell", "a", "b"])

        def regions():
            now, held = None, []
            for batch in batches:
                cells, ids, root, side, n = (batch.column(c).to_numpy() for c in range(5))
                if not len(cells):
                    continue
                sketch = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(len(cells), SKETCH).astype(np.int16)
                starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
                    if held and cells[s] != now:
                        yield now, held
                        held = []
                    now = cells[s]
                    held.append([*(x[s:e] for x in (ids, root, side, n, sketch)), batch.column(6).slice(s, e - s).to_pylist()])
            if held:
                yield now, held

        for cell, held in regions():
            *arrays, packed = zip(*held)
            out = solve(cell, *(np.concatenate(x) if len(x) > 1 else x[0] for x in arrays), sum(packed, []))
            if out is not None:
                yield out

    dealt = rows.select("cell", "id", "root", "side", "n", "sketch", "fine").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "cell long, a long, b long")


def _solved(rows: DataFrame, width: int, seed: int, p: int, q: int) -> DataFrame:
    """Links (u, v) inside regions of (cell, id, root, side, text) that join two
    components: members by members of other components (and, where the region
    has two sides, of the other side), size and sketch first, sets after, until
    one component is left or all are compared."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.combine_chunks()
        ids, parts = table["id"].to_numpy(), []
        for _, raw, at in chunks(table["text"].chunk(0)):
            flat, to = sets(raw, at, width, seed)
            parts += [flat[s:e] for s, e in zip(to[:-1].tolist(), to[1:].tolist())]
        n = np.array([len(x) for x in parts])
        sketch = np.stack([np.minimum(np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255) for x in parts]).astype(np.int16)
        root = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        sizes = np.bincount(root)
        side = table["side"].to_numpy()
        two = side.min() != side.max()
        found = []
        for i in np.argsort(sizes[root], kind="stable").tolist():
            if sizes[root[i]] == len(ids):
                break
            near = (root != root[i]) & (np.minimum(n, n[i]) * q >= np.maximum(n, n[i]) * p)
            if two:
                near &= side != side[i]
            at = np.flatnonzero(near)
            at = at[np.abs(sketch[at] - sketch[i]).sum(1, dtype=np.int64) * (q + p) <= (n[at] + n[i]) * (q - p)]
            for j in at.tolist():
                if root[j] != root[i]:
                    both = len(np.intersect1d(parts[i], parts[j], assume_unique=True))
                    if both * q >= (n[i] + n[j] - both) * p:
                        found.append((ids[i], ids[j]))
                        old, new = root[j], root[i]
                        sizes[new] += sizes[old]
                        sizes[old] = 0
                        root[root == old] = new
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(list(u), pa.int64()), "v": pa.array(list(v), pa.int64())})

    return rows.groupBy("cell").applyInArrow(run, "u long, v long")


def _blocks(dense: DataFrame) -> DataFrame:
    """(cell, id, side) for regions of (cell, id): regions that overlap become
    one, in blocks against blocks; where more than ``CLUSTER`` texts hang
    together the regions stay as they are."""
    least = dense.groupBy("cell").agg(F.min("id").alias("v"))
    root = components(dense.join(least, "cell").select(F.col("id").alias("u"), "v"))
    whole = dense.select("id").distinct().join(root.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = whole.groupBy("root").agg(F.count("*").alias("size"))
    member = cut(whole.join(sizes, "root"), "member")
    n = F.ceil(F.col("size") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")
    met = member.where(F.col("size") <= CLUSTER).select("id", "root", own.alias("i"), F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    met = met.select(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "id", (F.col("i") > F.col("j")).cast("int").alias("side"))
    rest = dense.join(member.where(F.col("size") > CLUSTER).select("id"), "id").select("cell", "id", F.lit(0).alias("side"))
    return met.unionByName(rest)


def _texts(docs: DataFrame, ids: DataFrame, sets_of: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, text): one text for each set in ``ids``."""

    def check(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, raw, at in chunks(batch.column(1)):
                flat, to = sets(raw, at, width, seed)
                got = pa.array(_digests(flat, to)[0].view(np.int64))
                want, text = batch.column(0).slice(i, len(got)), batch.column(1).slice(i, len(got))
                keep = pa.array(got.to_numpy() == want.to_numpy())
                yield pa.RecordBatch.from_arrays([want.filter(keep), text.filter(keep)], ["id", "text"])

    wanted = sets_of.join(ids, "id").select("id", F.col("doc").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(wanted, "doc_id").select("id", "text")
    return rows.mapInArrow(check, "id long, text string").dropDuplicates(["id"])


def join(docs: DataFrame, width: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id for links of similarity p / q or more."""
    spark, seed = docs.sparkSession, 1
    while True:
        profile = cut(profiles(docs, width, seed), "profiles")
        known = profile.where("n > 0 and doc_id is not null")
        sets_of = cut(known.groupBy("id").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine"), F.min("check").alias("low"), F.max("check").alias("high")), "sets")
        if not sets_of.where("low <> high").limit(1).count():
            break
        seed += 1  # two sets with one digest: other hashes tell them apart
    texts, links, comp, level, radius = None, None, None, 0, 1 - p / q
    rows = docs.where("doc_id is not null and text is not null").select(F.lit(0).cast("long").alias("space"), "text")
    amount = sets_of.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Ids in regions are shortened to bytes that tell nearly all sets apart;
    # sets that share a short id are all candidates.
    short = min(8, max(3, -(-(amount[0].bit_length() + 6) // 8)))
    shortened = lambda c: F.col(c).bitwiseAND(F.lit((1 << 8 * short) - 1)) if short < 8 else F.col(c)
    sets_of = sets_of.withColumn("short", shortened("id"))
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def differing(pairs: DataFrame) -> DataFrame:
        """Pairs that would join two components as known so far."""
        if comp is None:
            return pairs
        of = lambda c: comp.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)").drop("a_root", "b_root")

    possible = F.col("apart") * (q + p) <= F.col("most") * (q - p)

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs with what sketches say of them."""
        open_ones = cut(pairs.select("a", "b"), "sketched")
        grouped = _grouped(open_ones)
        out = few(cut(_bounded(grouped, sets_of), "bounds"))
        release(open_ones, grouped)
        return out

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        open_ones = cut(pairs.select("a", "b"), "pairs")
        grouped = _grouped(open_ones)
        out = cut(_compared(grouped, texts, width, seed, p, q, True).select(F.col("a").alias("u"), F.col("b").alias("v")), name)
        release(open_ones, grouped)
        return out

    def add(more: DataFrame) -> None:
        """Takes a table of links into the links and components."""
        nonlocal links, comp
        if comp is not None and not more.limit(1).count():
            release(more)
            return
        before, old = links, comp
        links = more if links is None else cut(links.union(more), "links")
        comp = few(components(links if old is None else more.union(old)))
        release(before, old, more if before is not None else None)

    while True:
        expected = 4.8 * (q - p) / (q + p) * amount[1] if level == 0 else 4.8 * (q - p) / (q + p) * rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / 5
        parts = max(least_parts, int(expected / PART))
        found = cut(_candidates(_regions(rows, width, seed, p, q, level, parts, short), short), "candidates")
        pairs = found.where("cell is null").select(F.col("a").alias("x"), F.col("b").alias("y"))
        crowd = few(cut(found.where("cell is not null").select("cell", F.col("a").alias("short")).distinct().join(sets_of.select("short", "id"), "short").select("cell", F.col("id").alias("a")), "crowd"))
        pivots = few(cut(crowd.groupBy("cell").agg(F.min("a").alias("b")), "pivots"))
        waiting = few(cut(crowd.join(pivots, "cell").where("a <> b"), "waiting"))
        pivoted = waiting.select(shortened("a").alias("x"), shortened("b").alias("y"))
        bounds = bounded(differing(_near(pairs.union(pivoted).distinct(), sets_of, p, q)))
        near = bounds.where(possible).select("a", "b")
        release(found)
        if texts is None:
            ids = crowd.select(F.col("a").alias("id")).union(near.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
            texts = cut(_texts(docs, ids, sets_of, width, seed), "texts")
        release(crowd, pivots)
        # One link a set first: most other candidates then lie within a component.
        first = few(cut(near.groupBy("a").agg(F.min("b").alias("b")), "first"))
        add(linked(first, "links"))
        add(linked(differing(near.join(first, ["a", "b"], "left_anti")), "rest"))
        release(bounds, first)
        # Crowded cells that hold several components, the largest of each member
        # first: what it links often settles the others.
        again, turn = None, 0
        while True:
            members = few(cut(waiting.join(differing(waiting).select("cell").distinct(), "cell"), "members"))
            release(waiting)
            if not members.limit(1).count():
                release(members)
                break
            now = members
            if turn < TURNS:
                sizes = members.groupBy("cell").agg(F.count("*").alias("n"))
                largest = members.join(sizes, "cell").groupBy("a").agg(F.max(F.struct("n", "cell")).alias("x")).select("x.cell").distinct()
                now = few(cut(members.join(as_few(largest, members), "cell"), "now"))
            waiting, turn = few(cut(members.join(now.select("cell").distinct(), "cell", "left_anti"), "waiting")), turn + 1
            tidy_driver(spark)
            bounds = bounded(now.select("a", "b").distinct())
            grouped = _grouped(bounds.where(possible).select("a", "b"))
            far = few(cut(_compared(grouped, texts, width, seed, p, q, False), "distances"))
            release(grouped)
            least_d = 2 * F.col("apart") / (F.col("most") + F.col("apart"))
            known_d = bounds.join(far, ["a", "b"], "left").select("a", "b", F.coalesce(1 - F.col("shared") / F.col("whole"), least_d).alias("d"))
            far_of = now.join(known_d, ["a", "b"])
            border = far_of.where(F.col("d") > radius + 1e-12).groupBy("cell").agg(F.min("d").alias("border"))
            kept = few(cut(far_of.join(as_few(border, now), "cell").where(F.col("d") >= F.least(F.col("border") - radius, F.lit(radius)) - 1e-9).select("cell", F.col("a").alias("id")), "kept"))
            # Members within the radius are linked to the pivot.
            ball = cut(far.where(F.col("shared") * q >= F.col("whole") * p).select(F.col("a").alias("u"), F.col("b").alias("v")), "ball")
            release(members, now, far, bounds)
            add(ball)
            large = kept.groupBy("cell").count().where(F.col("count") > LOCAL).select("cell")
            # Sketches move to the regions, fine ones to the pairs that they leave
            # open or to regions with very many of these; texts to what is open then.
            small = kept.join(large, "cell", "left_anti")
            rooted = lambda rows: rows.join(comp.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
            # Regions that the balls have joined into one component are settled.
            within = few(cut(rooted(small), "within"))
            parted = within.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
            coarse = sets_of.select("id", "n", "sketch", F.lit(None).cast("binary").alias("fine"))
            open_pairs = cut(_paired(as_few(within.join(parted, "cell"), within).join(coarse, "id").withColumn("side", F.lit(0)), p, q), "open")
            release(within)
            bounds = bounded(differing(open_pairs.where("b is not null").select("a", "b").distinct()))
            add(linked(bounds.where(possible), "settled"))
            release(bounds)
            dense = few(cut(open_pairs.where("b is null").select("cell", F.col("a").alias("id")), "dense"))
            if dense.limit(1).count():
                blocks = cut(_blocks(dense), "blocks")
                finer = cut(_paired(rooted(blocks).join(sets_of, "id"), p, q), "finer")
                add(linked(differing(finer.where("b is not null").select("a", "b").distinct()), "fine"))
                still = cut(blocks.join(finer.where("b is null").select("cell", F.col("a").alias("id")), ["cell", "id"]), "still")
                if still.limit(1).count():
                    add(cut(_solved(rooted(still.join(texts, "id")).select("cell", "id", "root", "side", "text"), width, seed, p, q), "solved"))
                release(blocks, finer, still)
            release(dense)
            release(open_pairs)
            more = cut(kept.join(large, "cell").select("cell", "id"), "more")
            release(kept)
            if not more.limit(1).count():
                release(more)
            else:
                joined = more if again is None else cut(again.union(more), "again")
                if again is not None:
                    release(again, more)
                again = joined
        if level:
            release(rows)
        if again is None:
            break
        rows, level = cut(again.join(texts, "id").select(F.col("cell").alias("space"), "text"), "rows"), level + 1
        release(again)
    release(texts, links)
    tidy_driver(spark)
    least = sets_of.select("id", "doc").join(comp.select(F.col("u").alias("id"), "v"), "id", "left").select("id", "doc", F.coalesce("v", "id").alias("root"))
    roots = least.groupBy("root").agg(F.min("doc").alias("component"))
    of_set = least.join(roots, "root").select("id", "component")
    out = profile.select("doc_id", "n", "id").join(of_set, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """``docs`` with the least doc_id of every component, as one row, and all
    rows without shingles or doc_id."""
    found = join(docs, width, p, q)
    kept = found.where("doc_id = component_id and n_shingles > 0").select("doc_id").distinct()
    alone = found.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct()
    many = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0
    if not many:
        return docs.join(kept.union(alone), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = docs.where(has_words).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(docs.where(~has_words & F.col("doc_id").isNotNull())).unionByName(docs.where("doc_id is null"))
