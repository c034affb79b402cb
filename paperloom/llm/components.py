"""Connected components: forests of parts, then alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, release

#: Edges that a task holds at once; a graph of no more is solved in one task.
ALONE = 1 << 20


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest).distinct()


def _forest(edges: DataFrame) -> DataFrame:
    """(u, v) with the components of ``edges``: every ``ALONE`` edges of a task
    become a row for each of their nodes but the least of a component, v."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solve(held):
            u, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            a, b = at[: len(u)], at[len(u) :]
            root = np.arange(len(nodes))
            while len(a):
                # Larger roots hook to the least that an edge offers, then trees become stars.
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
                a, b = root[a], root[b]
                a, b = a[a != b], b[a != b]
            own = root != np.arange(len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])

        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, ALONE):
                part = batch.slice(i, ALONE)
                if held and size + part.num_rows > ALONE:
                    yield solve(held)
                    size = 0
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                size += part.num_rows
        if held:
            yield solve(held)
            give_back()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u of an edge but the least of its component, v.

    Tasks make forests of their own edges; what is left is solved in one task
    if it is no more than ``ALONE`` edges. Else each round is joins and
    pre-aggregations of edges; their number grows with the logarithm of the
    longest chain. Every round is cut, so a lost executor costs one round. An
    edge table without rows gives one without rows.
    """
    now, mark = cut(_forest(edges), "edges"), None
    while True:
        n = now.count() if mark is None else mark[0]
        if n <= ALONE:
            before, now = now, cut(_forest(now.coalesce(1)), "edges")
            release(before)
            return now
        before, now = now, cut(_small(_large(now) if mark is not None else now), "edges")
        release(before)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == mark:
            return now
        mark = seen
