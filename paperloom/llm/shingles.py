"""Shingle sets of whole texts, by numpy over Arrow buffers.

A word is a run of bytes other than ASCII white space, lower-cased in A-Z; a
shingle is so many words in a row (a text with fewer words is one shingle). Words
and shingles are 64-bit hashes: random values of the bytes summed along powers of
an odd number, then mixed. Two different shingles of one comparison meet with
probability of about 2**-64 times the pairs compared.
"""

from __future__ import annotations

from functools import cache

#: Bytes that are hashed at once (one longer text still goes alone).
CHUNK = 1 << 20


def mixed(x):
    """A bijection of 64-bit numbers with good avalanche."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _tables(seed: int):
    import numpy as np

    rng = np.random.default_rng(seed)
    value = rng.integers(0, 2**64, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space, int(rng.integers(0, 2**63)) * 2 + 1


_POWERS: dict = {}


def _powers(n: int, seed: int):
    """Powers of the odd number and of its inverse, up to n of them."""
    import numpy as np

    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        odd = _tables(seed)[2]
        out = []
        for x in (odd, pow(odd, -1, 2**64)):
            p = np.full(size, np.uint64(x))
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        if n > CHUNK + 1:
            return out
        have = _POWERS[seed] = out
    return have


def buffers(column):
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    import numpy as np
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def chunks(column):
    """Ranges of rows that together hold about CHUNK bytes: first row, bytes,
    offsets from 0."""
    raw, at = buffers(column)
    i = 0
    while i < len(at) - 1:
        j = i + 1
        while j < len(at) - 1 and at[j + 1] - at[i] <= CHUNK:
            j += 1
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def sliding_least(values, width: int):
    """Least of each ``width`` values in a row, by prefix and suffix minima of
    blocks."""
    import numpy as np

    n = len(values)
    rows = -(-n // width)
    full = np.full(rows * width, np.uint64(2**64 - 1))
    full[:n] = values
    grid = full.reshape(rows, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - width + 1)
    return np.minimum(backward[starts], forward[starts + width - 1])


def word_hashes(raw, at, seed: int = 1):
    """Hash of every word and the row that it is in."""
    import numpy as np

    value, space, _ = _tables(seed)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = space[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = True, blank[:-1], True, blank[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    before[edges], after[edges - 1] = True, True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    forth, back = _powers(n + 1, seed)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value[raw] * forth[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * back[starts]
        hashes = mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes, np.searchsorted(at, starts, "right") - 1


def sets(raw, at, width: int, seed: int = 1):
    """Distinct shingle hashes of each row, sorted within it, and offsets."""
    import numpy as np

    rows = len(at) - 1
    hashes, row = word_hashes(raw, at, seed)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    take = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    begin = np.cumsum(take) - take
    at_word = np.repeat(first - begin, take) + np.arange(take.sum())
    of_row = np.repeat(np.arange(rows), take)
    used = np.minimum(count, width)[of_row]
    with np.errstate(over="ignore"):
        total = used.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for j in range(width):
            there = used > j
            part = hashes[np.minimum(at_word + j, max(len(hashes) - 1, 0))] if len(hashes) else hashes
            total = total + np.where(there, mixed(part + np.uint64(j + 1)) * np.uint64(2 * j + 3), np.uint64(0))
    got = mixed(total)
    ends = begin + take
    for s, e in zip(begin.tolist(), ends.tolist()):
        if e - s > 1:
            got[s:e].sort()
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (of_row[1:] != of_row[:-1])
    sizes = np.bincount(of_row[new], minlength=rows)
    return got[new], np.concatenate([[0], np.cumsum(sizes)])
