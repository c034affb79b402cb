"""What a worker holds at once while candidates are found."""

import random

from pyspark.sql import functions as F

from paperloom.llm import common, jaccard

from .test_operators import documents


def test_a_pair_comes_once_for_each_part(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in (5, 9, 300)] + [" ".join(f"v{rng.randrange(10**6)}" for _ in range(600))]
    rows = documents(spark, texts).select(F.lit(0).cast("long").alias("space"), "text")
    for parts, short in ((1, 3), (2, 8)):
        found = jaccard._candidates(jaccard._regions(rows, 5, 1, 8, 10, 0, parts, short), short).collect()
        pairs = [frozenset((r["a"], r["b"])) for r in found]
        assert len(set(pairs)) == 3 and len(pairs) <= 3 * parts and not any(r["cell"] for r in found)


def test_crowded_cells_give_members(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base + [f"y{i}"]) for i in range(jaccard.CELL + 2)]
    rows = documents(spark, texts).select(F.lit(0).cast("long").alias("space"), "text")
    found = [r for r in jaccard._candidates(jaccard._regions(rows, 5, 1, 8, 10, 0, 1, 4), 4).collect() if r["cell"] is not None]
    assert len({r["a"] for r in found}) == len(texts) and len(set(found)) == len(found) > 0


def test_cut_hands_over_small_batches(spark):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    before = spark.conf.get(common.BATCH)
    sizes = [r["n"] for r in common.cut(rows.mapInArrow(run, "n long"), "sizes").collect()]
    assert max(sizes) < 8 << 20 and sum(sizes) > 8000 * 4000
    assert spark.conf.get(common.BATCH) == before
