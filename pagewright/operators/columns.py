"""Regions of a page and their reading order without a model: a page is cut at its empty bands, over and over.

Within a region, boxes in the order of one side are in the same island as long as they begin before the furthest end so
far; what lies between islands is an empty band. A region is cut along the axis that has the wider band, at all bands of
this axis that are wide enough: into rows from top to bottom, or columns from left to right. What holds no wide band is
left whole. A region's path of island numbers is its place in reading order.

All regions of all pages are cut at once, by windows over their boxes, and a region has at most its page's boxes. The
number of rounds is fixed: a page has few levels, and a region that is cut to the end stays as it is.

Defined results: boxes without a coordinate don't part others and stand last in their region; equal boxes have equal
regions; repeated rows stay; other columns are kept (but `region` and names that begin with `_cut_`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .page import PAGE

#: Rounds; the narrowest bands between columns and rows that part regions, in the units of the page.
DEPTH, BETWEEN_COLUMNS, BETWEEN_ROWS = 6, 8.0, 8.0


def _islands(boxes: DataFrame, axis: str, least: float) -> DataFrame:
    """Number of each box's island along an axis, and the widest band of the region (0 without any)."""
    a, b = F.col(f"{axis}0"), F.col(f"{axis}1")
    by = W.partitionBy(*PAGE, "region")
    along = by.orderBy(a.asc_nulls_last(), b, F.col("_cut_id"))
    reached = F.max(b).over(along.rowsBetween(W.unboundedPreceding, -1))
    boxes = boxes.withColumn(f"_cut_{axis}gap", F.coalesce(a - reached, F.lit(0.0)))
    boxes = boxes.withColumn(f"_cut_{axis}", F.sum(F.when(F.col(f"_cut_{axis}gap") >= least, 1).otherwise(0)).over(along))
    return boxes.withColumn(f"_cut_{axis}gap", F.max(F.col(f"_cut_{axis}gap")).over(by))


def regions(boxes: DataFrame, depth: int = DEPTH, between_columns: float = BETWEEN_COLUMNS, between_rows: float = BETWEEN_ROWS) -> DataFrame:
    """Boxes (doc_id, pnum, x0, y0, x1, y1, ...) with the path of their region, array<int>."""
    out = boxes.withColumn("region", F.array().cast("array<int>")).withColumn("_cut_id", F.xxhash64("x0", "y0", "x1", "y1"))
    for _ in range(depth):
        out = _islands(_islands(out, "x", between_columns), "y", between_rows)
        # of equal bands those between rows are taken: a heading stands above its columns
        columns = (F.col("_cut_xgap") >= between_columns) & ((F.col("_cut_xgap") > F.col("_cut_ygap")) | (F.col("_cut_ygap") < between_rows))
        cut = F.when(columns, F.col("_cut_x")).otherwise(F.col("_cut_y")).cast("int")
        out = out.withColumn("region", F.concat("region", F.array(cut))).drop("_cut_x", "_cut_y", "_cut_xgap", "_cut_ygap")
    return out.drop("_cut_id")


def layout(boxes: DataFrame, **options) -> DataFrame:
    """doc_id, pnum, box_idx, label, x0, y0, x1, y1, position: one box of text for each region, numbered in reading order,
    as a layout and an order model would give them."""
    r = regions(boxes, **options)
    envelope = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    place = (F.row_number().over(W.partitionBy(*PAGE).orderBy("region")) - 1).cast("int")
    got = r.groupBy(*PAGE, "region").agg(*envelope)
    return got.select(*PAGE, place.alias("box_idx"), F.lit("Text").alias("label"), "x0", "y0", "x1", "y1", place.alias("position"))


def order(boxes: DataFrame, **options) -> DataFrame:
    """The places of regions: doc_id, pnum, box_idx, position."""
    return layout(boxes, **options).select(*PAGE, "box_idx", "position")


def reading_order(blocks: DataFrame, tolerance: float = 1.25, **options) -> DataFrame:
    """Blocks (doc_id, pnum, block_no, x0, y0, x1, y1) with their place on the page: by region, then from top to bottom and
    left to right."""
    by: list[str | Column] = ["region", F.round(F.col("y0") / tolerance).asc_nulls_last(), F.col("x0").asc_nulls_last(), "block_no"]
    return regions(blocks, **options).withColumn("place", F.row_number().over(W.partitionBy(*PAGE).orderBy(*by)) - 1).drop("region")
