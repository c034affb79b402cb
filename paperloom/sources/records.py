"""Readers and writers: documents by suffix, logs of JSON lines, caches.

Readers take explicit schemas. Logs tolerate a truncated last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of documents that can be loaded.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
CACHE_VERSION = 2


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, suffix, dataset (top folder), split of every document."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    inner = F.regexp_replace("path", "^.*?" + folder.rstrip("/").rpartition("/")[2] + "/", "")
    rows = files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("suffix"), F.split(inner, "/")[0].alias("dataset"))
    return rows.where(F.col("suffix").isin(*SUFFIXES)).withColumn("split", split_of(F.col("path")))


def split_of(path: Column) -> Column:
    """train, test, validation or unknown, by the path."""
    low = F.lower(path)
    return F.when(F.contains(low, F.lit("train")), "train").when(F.contains(low, F.lit("test")), "test").when(F.contains(low, F.lit("valid")) | F.contains(low, F.lit("val")), "validation").otherwise("unknown")


def pages(files: DataFrame, load) -> DataFrame:
    """One row a page by an injected loader, which yields (text, image) for
    (name, content); models run once a Python worker."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, i + 1, text, image) for p, n, c in zip(pdf.path, pdf.name, pdf.content) for i, (text, image) in enumerate(load(n, bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "image"])

    return files.select("path", "name", "content").mapInPandas(run, "path string, page_number int, text string, image binary")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones, such as a truncated last line, are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def cached(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys whose cached lines can be used: current version and any box."""
    good = cache.where(F.col("schema_version") == CACHE_VERSION).groupBy("fingerprint").agg(F.count("x1").alias("n")).where("n > 0")
    return keys.join(good, "fingerprint", "left_semi")


def lines_of_words(words: DataFrame) -> DataFrame:
    """Lines from words of one (block, paragraph, line): joined text, mean
    confidence of a hundred, union of boxes."""
    rows = words.groupBy("doc_id", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda w: w["text"]), " ").alias("text"),
        (F.avg("conf") / 100).alias("confidence"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )
    return rows


def flat_json(rows: DataFrame, name: Column) -> DataFrame:
    """A file name and a JSON document for each row."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("invoice")), "[^A-Za-z0-9._-]+", "_")
    return rows.select(F.concat(safe, F.lit(".json")).alias("file"), F.to_json(F.struct(*rows.columns)).alias("json"))
