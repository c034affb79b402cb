"""Streams of attempts and corrections: latest state, windows, sessions.

Extensions for continuous runs: each has a batch counterpart with the same
result once the stream has seen all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_attempts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Attempts once each, however often they are delivered within the delay."""
    return events.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["log_seq"])


def failure_rates(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Attempts and failures of each status in tumbling windows."""
    return events.withWatermark("started_at", late).groupBy(F.window("started_at", width).alias("w"), "execution_status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "execution_status", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of attempts on a document without a longer pause."""
    own = F.session_window("started_at", gap).alias("w")
    return events.withWatermark("started_at", late).groupBy("document_id", own).agg(F.count("*").alias("n")).select("document_id", F.col("w.start").alias("start"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """The last attempt of each document, kept as streaming state (complete or
    update mode)."""
    return events.groupBy("document_id").agg(F.max("log_seq").alias("log_seq"), F.max_by("execution_status", "log_seq").alias("execution_status"), F.count("*").alias("attempts"))


def run_once(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """Drive a stream over all that is there and return what it says, from
    tables in ``folder``: every batch of an appending stream, the last one of a
    complete one. A batch that runs again after a failure overwrites its table."""
    done: list[int] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{n}")
        done.append(n)

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return df.sparkSession.createDataFrame([], df.schema)
    wanted = done if mode == "append" else done[-1:]
    return df.sparkSession.read.schema(df.schema).parquet(*[f"{folder}/out/{n}" for n in sorted(set(wanted))])
