"""Where documents go: JSON, tables by document, and debug tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import geometry as G

#: What is drawn over a page's image, by the kind of dump: the column that labels a box, if any.
OVERLAYS = {"spans": "block_type", "layout": "label", "order": "position", "detection": None, "ocr": "text", "cells": "label"}


def document_json(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, json: each document with its chunks in order, in an envelope of code and message."""
    fields = [c for c in chunks.columns if c not in ("doc_id", "index")]
    of = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", *fields))).alias("chunks"))
    body = documents.join(of, "doc_id", "left")
    data = F.struct(*[c for c in body.columns])
    return body.select("doc_id", F.to_json(F.struct(F.lit(200).alias("code"), F.lit("success").alias("msg"), data.alias("data"))).alias("json"))


def safe_name(c: Column) -> Column:
    """The last part of a client's file name, without what could leave its folder."""
    base = F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1), -1)
    return F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_. -]", "_"), r"^\.+", "")


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunks as Parquet in a fixed number of folders by document, so that one document is found without a full scan."""
    out = chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    out.repartition("bucket").sortWithinPartitions("doc_id", "index").write.mode("overwrite").partitionBy("bucket").parquet(path)


def overlay(boxes: DataFrame, label: str | None, frame: tuple[float, ...], image: tuple[float, ...]) -> DataFrame:
    """doc_id, pnum, marks: what a drawing of a page shows, as boxes in units of the image with their labels, in order."""
    moved = G.rescale(G.box(), G.literal(*frame), G.literal(*image))
    text = F.col(label).cast("string") if label else F.lit(None).cast("string")
    mark = F.struct(*[c.alias(n) for c, n in zip(moved, ("x0", "y0", "x1", "y1"))], text.alias("label"))
    by_place = F.struct(moved[1].alias("by"), moved[0].alias("bx"), mark.alias("mark"))
    return boxes.groupBy("doc_id", "pnum").agg(F.transform(F.sort_array(F.collect_list(by_place)), lambda x: x["mark"]).alias("marks"))


def dump_overlays(kinds: dict[str, DataFrame], path: str, frames: dict[str, tuple[float, ...]], image: tuple[float, ...], max_pages: int = 10) -> None:
    """A JSON table of marks per page for every kind of `OVERLAYS` that is given; frames: the units of its boxes, if they
    aren't the image's. Drawing them over the pictures is a contract of its own."""
    for kind, boxes in kinds.items():
        overlay(boxes.filter(F.col("pnum") < max_pages), OVERLAYS[kind], frames.get(kind, image), image).write.mode("overwrite").json(f"{path}/{kind}")


def dump_documents(texts: DataFrame, blocks: DataFrame, tables: DataFrame | None, path: str) -> None:
    """The whole text of each document, its merged blocks in order, and the rows of its tables (csv) as JSON tables."""
    texts.write.mode("overwrite").json(f"{path}/full_text")
    blocks.repartition("doc_id").sortWithinPartitions("doc_id", "index").write.mode("overwrite").json(f"{path}/text_blocks")
    if tables is not None:
        tables.write.mode("overwrite").json(f"{path}/tables")


def dump(tables: dict[str, DataFrame], path: str, max_pages: int = 10) -> None:
    """Stage tables as packed JSON, the first pages of each document."""
    for name, df in tables.items():
        (df.filter(F.col("pnum") < max_pages) if "pnum" in df.columns else df).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
