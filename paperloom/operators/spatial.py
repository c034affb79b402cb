"""Geometry over recognized lines: order, rows, columns, zones, neighbours.

Every join carries equality on (doc_id, page_number), so pairs stay within a
page; nearest joins keep the least by an aggregate instead of a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_number")


def reading_order(lines: DataFrame) -> DataFrame:
    own = Window.partitionBy("doc_id").orderBy("page_number", "y1", "x1", "line_index")
    return lines.withColumn("reading_order", F.row_number().over(own) - 1)


def row_buckets(lines: DataFrame, height: int = 18) -> DataFrame:
    """Texts of lines whose tops round (half to even) to the same bucket."""
    bucket = F.bround(F.col("y1") / height, 0).cast("int")
    rows = lines.groupBy(*PAGE, bucket.alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("x1", "line_index", "text"))).alias("cells"))
    return rows.select(*PAGE, "bucket", F.array_join(F.transform("cells", lambda c: c["text"]), " ").alias("text"), F.size("cells").alias("n_cells"))


def gap_segments(lines: DataFrame, gap: int = 100) -> DataFrame:
    """Segments of a visual line, split where the gap to the left is large."""
    own = Window.partitionBy(*PAGE, "row_index").orderBy("x1", "line_index")
    far = (F.col("x1") - F.lag("x2").over(own) >= gap).cast("int")
    marked = lines.withColumn("split", F.coalesce(far, F.lit(0)))
    return marked.withColumn("segment", F.sum("split").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("split")


def column_bounds(lines: DataFrame) -> DataFrame:
    """Columns by name with the midpoints to their neighbours as bounds."""
    cols = lines.groupBy(*PAGE, "col_name").agg((F.sum(F.col("x1") + F.col("x2")).cast("double") / (2 * F.count("*"))).alias("center"))
    own = Window.partitionBy(*PAGE).orderBy("center")
    return cols.select(*PAGE, "col_name", "center", ((F.lag("center").over(own) + F.col("center")) / 2).alias("x_min"), ((F.lead("center").over(own) + F.col("center")) / 2).alias("x_max"))


def assign_columns(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """The column that a line's centre is in, else the nearest one."""
    mid = (F.col("x1") + F.col("x2")) / 2
    rows = lines.select(*PAGE, "line_index", mid.alias("mid")).join(columns, list(PAGE))
    outside = ~((F.col("mid") >= F.coalesce("x_min", F.lit(-1e9))) & (F.col("mid") < F.coalesce("x_max", F.lit(1e9))))
    best = rows.groupBy(*PAGE, "line_index").agg(F.min(F.struct(outside.cast("int").alias("out"), F.abs(F.col("mid") - F.col("center")).alias("d"), F.col("col_name"))).alias("x"))
    return best.select(*PAGE, "line_index", F.col("x.col_name").alias("col_name"), (F.col("x.out") == 0).alias("inside"))


def edges(nodes: DataFrame, most: float = 60) -> DataFrame:
    """Typed edges between lines of a page that are near each other."""
    a = nodes.select(*PAGE, F.col("line_index").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = nodes.select(*PAGE, F.col("line_index").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = a.join(b, list(PAGE)).where("a <> b")
    dx = (F.col("b_x1") + F.col("b_x2") - F.col("a_x1") - F.col("a_x2")) / 2
    dy = (F.col("b_y1") + F.col("b_y2") - F.col("a_y1") - F.col("a_y2")) / 2
    pairs = pairs.withColumn("d2", (dx * dx + dy * dy).cast("double")).where(F.col("d2") <= most * most)
    tests = {
        "overlaps": (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2")),
        "right_of": F.col("b_x1") >= F.col("a_x2"),
        "left_of": F.col("b_x2") <= F.col("a_x1"),
        "below": F.col("b_y1") >= F.col("a_y2"),
        "above": F.col("b_y2") <= F.col("a_y1"),
        "same_line": F.abs(dy) <= 8,
        "same_column": F.abs(dx) <= 20,
    }
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return pairs.select(*PAGE, "a", "b", "d2", F.explode(kinds).alias("relation"))


def nearest(labels: DataFrame, values: DataFrame, allowed: Column, cost: Column) -> DataFrame:
    """For each label (l_*) the value (v_*) of least cost on its page."""
    l = labels.select(*PAGE, *[F.col(c).alias(f"l_{c}") for c in ("line_index", "text", "x1", "y1", "x2", "y2")])  # noqa: E741
    v = values.select(*PAGE, *[F.col(c).alias(f"v_{c}") for c in ("line_index", "text", "x1", "y1", "x2", "y2")])
    pairs = l.join(v, list(PAGE)).where(allowed)
    best = pairs.groupBy(*PAGE, "l_line_index").agg(F.min(F.struct(cost.cast("double").alias("cost"), F.col("v_line_index"), F.col("v_text"))).alias("x"))
    return best.select(*PAGE, F.col("l_line_index").alias("label_index"), F.col("x.v_line_index").alias("value_index"), F.col("x.v_text").alias("value"), F.col("x.cost").alias("cost"))


def bands(anchors: DataFrame, rows: DataFrame, margin: int = 8) -> DataFrame:
    """Rows between an anchor and the next one on the page: the last anchor
    before each row in one order of both, without a range join."""
    own = Window.partitionBy(*PAGE).orderBy("k", "kind", "anchor").rowsBetween(Window.unboundedPreceding, 0)
    marks = anchors.select(*PAGE, (F.col("y1") - margin).alias("k"), F.lit(0).alias("kind"), F.col("line_index").alias("anchor"), F.lit(None).cast("int").alias("line_index"))
    both = marks.unionByName(rows.select(*PAGE, F.col("y1").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("anchor"), "line_index"))
    return both.withColumn("anchor", F.last("anchor", ignorenulls=True).over(own)).where("kind = 1 and anchor is not null").select(*PAGE, "anchor", "line_index")


def blocks(lines: DataFrame, zones: dict[str, Column]) -> DataFrame:
    """A block for each zone: box, joined text, mean confidence."""
    zone = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in zones.items()])))
    rows = lines.select("*", zone.alias("zone"))
    out = rows.groupBy(*PAGE, "zone").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n_lines"), (F.sum("confidence").cast("double") / F.count("*")).alias("confidence"), F.array_sort(F.collect_list(F.struct(F.col("y1").alias("y"), F.col("x1").alias("x"), F.col("line_index").alias("i"), "text"))).alias("parts"))
    return out.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), " ")).drop("parts")


def outside_blocks(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines that no box of their page holds."""
    b = boxes.select(*PAGE, *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    l = lines.alias("l")  # noqa: E741
    held = (F.col("l.doc_id") == b["doc_id"]) & (F.col("l.page_number") == b["page_number"]) & (F.col("l.x1") >= b["b_x1"]) & (F.col("l.x2") <= b["b_x2"]) & (F.col("l.y1") >= b["b_y1"]) & (F.col("l.y2") <= b["b_y2"])
    return l.join(b, held, "left_anti")
