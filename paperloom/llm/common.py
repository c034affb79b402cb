"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters that are no ASCII white space, as the contracts define a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that go to or come from a Python worker at once: batches stand in the
#: executor's memory outside its heap, which it doesn't give back.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"
#: Folders of the tables that are cut and still in use.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    folder of its own; on a cluster that would lose files, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This ends the lineage: a lost executor costs no recomputation of what is
    before the cut, and later steps read only the columns they need. Shuffle
    files of the write go when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom-{uuid.uuid4().hex}/{name}"
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH, None)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Rows that one task handles, and that go with tasks, where a shuffle costs more.
FEW = 1 << 17
#: Tables that few() has made one part.
_ALONE: weakref.WeakSet = weakref.WeakSet()


def few(table: DataFrame) -> DataFrame:
    """A table that was cut as one part, to be broadcast in joins, if it has at
    most ``FEW`` rows: what groups and joins it then needs no shuffle."""
    if table.count() > FEW:
        return table
    out = table.coalesce(1).hint("broadcast")
    if table in _PATHS:
        _PATHS[out] = _PATHS.pop(table)
    _ALONE.add(out)
    return out


def as_few(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, with no more rows than ``tables``: broadcast if they are, as a
    join's result doesn't keep that."""
    return F.broadcast(df) if all(t in _ALONE for t in tables) else df


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote, once all that reads them is written."""
    for df in tables:
        path = _PATHS.pop(df, None) if df is not None else None
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def matched(rows: DataFrame, keys: DataFrame, on: list[str], often: int) -> DataFrame:
    """``rows`` joined with ``keys``, which count them in n. A key at one in
    ``often`` rows or more is one of so many at most: these go with the tasks,
    so none gathers its rows in one task."""
    hot = F.col("n") * often >= rows.count()
    return rows.join(F.broadcast(keys.where(hot)), on).unionByName(rows.join(keys.where(~hot), on))


def tidy_driver(spark: SparkSession) -> None:
    """Let the driver drop plans and broadcasts of steps that are over; many
    steps in one session would otherwise hold its memory at its most."""
    spark._jvm.java.lang.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def texts_of(column, step: int = 256):
    """The strings of an Arrow column, few at a time; nulls are empty."""
    for i in range(0, len(column), step):
        for text in column.slice(i, step).to_pylist():
            yield text or ""


#: What empties the tables that operators keep in a worker between their tasks.
CACHES: list = []


def give_back() -> None:
    """Empty what other operators keep in this Python worker and hand freed
    memory back to the system: workers live on between tasks, and what one task
    held would count on in the next."""
    import ctypes

    import pyarrow as pa

    for clear in CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
