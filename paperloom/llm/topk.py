"""Exact top-k by inner product: a Voronoi kNN join.

Pivots part the data into Voronoi groups, and rings of equal distance to the
pivot part each group into blocks. A summary of each block (count, greatest
distance to the pivot, greatest norm) bounds the inner product of any query q
with a member y: <q, y> = <q, p> + <q, y - p> lies within |q| * |y - p| of
<q, p>. Blocks that must hold k candidates by their lower bounds, even if all
rows with the query's own vec_id are among their rows, give each query a
threshold; only blocks whose upper bound reaches it get the query.
Blocks are solved locally and the partial lists merged.

Distribution: pivots grow with the data up to ``MOST_PIVOTS``, so pivots and
summaries are bounded and go with the tasks; queries go to the blocks. A block
with more than ``BLOCK_ROWS`` members is dealt by hash into parts, and so are
the queries that it gets beyond ``QUERY_BYTES``, so a vector that a third of
all rows share or a crowded group is spread. Members move once for each such
slice of queries of their own block, not at all if no query needs the block.
No candidate is capped: ties of bounds are kept.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without vec_id; a shorter vector counts
as padded with zeros; rows with the query's own vec_id are no candidates of
it; repeated rows are candidates each; ties of the score go to the smaller
vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RINGS, K, EVERY = 6, 5, 50
#: Pivots: one for so many vectors, between the least and the most.
PIVOT_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 2_000, 48, 2_048
#: Vectors of a block, and bytes of its queries, that one task takes.
BLOCK_ROWS, QUERY_BYTES = 16_384, 32 << 20
#: Numbers of a matrix that is held at once.
CELLS = 2_000_000
#: Room for rounding in the bounds, relative to their size.
SLACK = 1e-9


def _matrix(column, width: int | None = None):
    """A list column of numbers as one float64 matrix, short rows padded."""
    import numpy as np

    lens = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py() if len(column.offsets) else 0, int(lens.sum())).to_numpy(zero_copy_only=False).astype(np.float64)
    width = width or int(lens.max(initial=1))
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width))
    at = np.repeat(np.arange(len(lens)), lens)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _dot(a, b):
    """Inner products of integer matrices, exact as int64."""
    import numpy as np

    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the floor of scale times each component, of valid rows."""
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"))
    rows = rows.where("vec_id is not null and size(embedding) > 0").where(fine)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int | None = None, rings: int = RINGS, query_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for queries with vec_id % every = 0."""
    data = cut(quantised(vectors), "vectors")
    spark = data.sparkSession
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, data.count() // PIVOT_ROWS))
    picked = data.select("v").groupBy(F.xxhash64("v").alias("h")).agg(F.first("v").alias("v")).orderBy("h").limit(pivots).collect()
    empty = "query_id long, rank int, vec_id long, score long"
    if not picked:
        return spark.createDataFrame([], empty)
    width = max(data.agg(F.max(F.size("v"))).first()[0], 1)
    centres = [list(r["v"]) + [0.0] * (width - len(r["v"])) for r in picked]

    def few(batches, columns):
        """Rows few at a time, for a matrix with so many columns."""
        step = max(1, CELLS // columns)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(centres)
        for batch in few(batches, len(p)):
            x = _matrix(batch.column(1), width)
            d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1), 0)
            g = d.argmin(1)
            dist = np.sqrt(((x - p[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g, pa.int32()), pa.array(dist), pa.array(np.sqrt((x**2).sum(1)))], ["vec_id", "v", "g", "d", "norm"])

    placed = cut(data.mapInArrow(assign, "vec_id long, v array<double>, g int, d double, norm double"), "placed")
    far = placed.groupBy("g").agg(F.max("d").alias("far"), F.min("d").alias("near")).collect()
    span = {r["g"]: (r["near"], max(r["far"] - r["near"], 1e-9)) for r in far}
    edges = F.create_map(*[F.lit(x) for g, (lo, w) in sorted(span.items()) for x in (g, lo)]), F.create_map(*[F.lit(x) for g, (lo, w) in sorted(span.items()) for x in (g, w)])
    ring = F.least(F.floor((F.col("d") - F.element_at(edges[0], F.col("g"))) / F.element_at(edges[1], F.col("g")) * rings), F.lit(rings - 1)).cast("int")
    blocks = placed.withColumn("block", F.col("g") * rings + ring)
    summary = {r["block"]: tuple(r)[1:] for r in blocks.groupBy("block").agg(F.count("*"), F.max("d"), F.max("norm")).collect()}
    names = sorted(summary)
    parts = {b: -(-summary[b][0] // BLOCK_ROWS) for b in names}
    query_rows = query_rows or max(1, QUERY_BYTES // (8 * width))

    def needed(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(centres)[[b // rings for b in names]]
        count, radius, norm = (np.array([summary[b][i] for b in names], float) for i in range(3))
        labels = pa.array(names, pa.int32())
        for batch in few(batches, len(names)):
            q = _matrix(batch.column(1), width)
            size = np.sqrt((q**2).sum(1))[:, None]
            mid = q @ p.T
            reach = size * radius * (1 + SLACK) + SLACK
            high, low = np.minimum(mid + reach, size * norm * (1 + SLACK) + SLACK), mid - reach
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(count[order], axis=1) >= k + batch.column(2).to_numpy()[:, None]
            rows = np.arange(len(q))
            limit = np.where(enough.any(1), np.take_along_axis(low, order, 1)[rows, enough.argmax(1)], -np.inf)
            fits = high >= limit[:, None] - np.abs(limit[:, None]) * SLACK - 1e-6 if np.isfinite(limit).all() else high >= limit[:, None]
            to = pa.array(np.concatenate([[0], np.cumsum(fits.sum(1))]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(to, labels.take(pa.array(np.nonzero(fits)[1])))], ["vec_id", "v", "blocks"])

    asked = data.where(F.col("vec_id") % every == 0)
    # Rows with a query's own vec_id are no candidates, however many.
    times = asked.groupBy(F.col("vec_id").alias("query_id")).count()
    again = times.where("count > 1").limit(1).count() > 0
    own = asked.withColumn("own", F.lit(1).cast("long"))
    if again:
        own = asked.join(times, F.col("vec_id") == F.col("query_id")).select("vec_id", "v", F.col("count").alias("own"))
    plan = cut(own.mapInArrow(needed, "vec_id long, v array<double>, blocks array<int>"), "plan")
    asked_of = {r["block"]: r["count"] for r in plan.select(F.explode("blocks").alias("block")).groupBy("block").count().collect()}
    slices = {b: -(-n // query_rows) for b, n in asked_of.items()}

    def of_block(found: dict[int, int]):
        many = {b: n for b, n in found.items() if n > 1}
        if not many:
            return F.lit(1)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b in sorted(many) for x in (b, many[b])]), F.col("block")), F.lit(1))

    def all_below(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    queries = plan.select("vec_id", "v", F.explode("blocks").alias("block"))
    queries = queries.select("vec_id", "v", "block", dealt(of_block(slices), 1).alias("slice"), all_below(of_block(parts)).alias("part"))
    stored = blocks.where(F.col("block").isin(sorted(asked_of))) if len(asked_of) < len(names) else blocks
    stored = stored.select("vec_id", "v", "block", dealt(of_block(parts), 2).alias("part"), all_below(of_block(slices)).alias("slice"))

    def solve(key, left, right):
        import numpy as np
        import pyarrow as pa

        names_out = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names_out})
        left, right = left.combine_chunks(), right.combine_chunks()
        ids = right["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, y = ids[order], _matrix(right["v"].chunk(0), width)[order]
        qs, x = left["vec_id"].to_numpy(), _matrix(left["v"].chunk(0), width)
        out = []
        for i in range(0, len(qs), 512):
            s = _dot(x[i : i + 512], y)
            own = np.searchsorted(ids, qs[i : i + 512], "left"), np.searchsorted(ids, qs[i : i + 512], "right")
            keep = min(len(ids), k)
            for j in range(len(s)):
                row = s[j]
                at = np.arange(len(ids))
                if own[0][j] < own[1][j]:
                    at = np.delete(at, slice(own[0][j], own[1][j]))
                if len(at) > keep:
                    least = np.partition(row[at], len(at) - keep)[len(at) - keep]
                    above, ties = at[row[at] > least], at[row[at] == least]
                    at = np.concatenate([above, ties[: keep - len(above)]])
                out.append((np.full(len(at), qs[i + j]), ids[at], row[at]))
        return pa.table({n: pa.array(np.concatenate([o[c] for o in out]), pa.int64()) for c, n in enumerate(names_out)})

    keys = ["block", "part", "slice"]
    found = queries.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A repeated query row meets every block again; its lists are the same.
    ranked = found.withColumn("rank", F.row_number().over(best))
    if again:
        ranked = _without_repeats(found, times, k)
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _without_repeats(found: DataFrame, times: DataFrame, k: int) -> DataFrame:
    """Ranks where a query_id stands on several rows: of each candidate and
    score, its occurrences divided by the query's."""
    counted = found.groupBy("query_id", "vec_id", "score").agg(F.count("*").alias("n")).join(times, "query_id")
    once = counted.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.greatest(F.least((F.col("n") / F.col("count")).cast("int"), F.lit(k)), F.lit(1)))))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
