"""Stages that need models or decoders which aren't part of this library.

Each has a contract: the columns that it takes and gives. `plug` registers an implementation, a function of DataFrames;
without one a stage raises `NotAvailable` with the name of what is missing. Nothing here pretends to work."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class NotAvailable(RuntimeError):
    """A component that isn't installed or plugged in."""


@dataclass(frozen=True)
class Contract:
    takes: str
    gives: str
    needs: str


CONTRACTS = {
    "pdf_text": Contract("path string, content binary", "doc_id long, pnum int, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, font_size double, font_weight double", "a PDF text extractor"),
    "pdf_outline": Contract("path string, content binary", "doc_id long, toc array<struct<title:string,level:int,is_closed:boolean,n_kids:int,page_index:int,view_mode:string,view_pos:array<double>>>", "a PDF reader"),
    "page_image": Contract("path string, content binary", "doc_id long, pnum int, image binary, width int, height int", "a PDF renderer"),
    "text_detection": Contract("doc_id long, pnum int, image binary", "doc_id long, pnum int, line_idx int, x0 double, y0 double, x1 double, y1 double, confidence double", "a text detection model"),
    "layout_detection": Contract("doc_id long, pnum int, image binary", "doc_id long, pnum int, box_idx int, label string, x0 double, y0 double, x1 double, y1 double", "a layout model"),
    "reading_order": Contract("doc_id long, pnum int, image binary, boxes array<array<double>>", "doc_id long, pnum int, box_idx int, position int", "a reading order model"),
    "recognition": Contract("doc_id long, pnum int, image binary, langs array<string>", "doc_id long, pnum int, line_idx int, text string, confidence double, x0 double, y0 double, x1 double, y1 double", "a text recognition model"),
    "page_recognition": Contract("doc_id long, pnum int, pdf binary, lang string", "doc_id long, pnum int, text string", "a page recognition program"),
    "table_structure": Contract("doc_id long, pnum int, box_idx int, image binary", "doc_id long, pnum int, box_idx int, cell_idx int, label string, score double, x0 double, y0 double, x1 double, y1 double", "a table structure model"),
    "equations": Contract("doc_id long, pnum int, box_idx int, image binary, tokens int", "doc_id long, pnum int, box_idx int, latex string", "a formula model"),
    "text_editor": Contract("doc_id long, text string", "doc_id long, labels array<string>", "a text editing model"),
    "transcription": Contract("path string, content binary", "path string, summary string", "a speech model"),
    "video_audio": Contract("path string, content binary", "path string, content binary", "a video decoder"),
    "xls": Contract("path string, content binary", "path string, sheet string, row int, cells array<string>", "a reader of old spreadsheets"),
    "to_pdf": Contract("path string, content binary", "path string, content binary", "an office converter"),
    "fix_encoding": Contract("text string", "text string", "an encoding repair library"),
}
_PLUGGED: dict[str, Callable[..., DataFrame]] = {}
#: Stages that this library has something for, used unless another is plugged in: module and function. Layout and order
#: come from the places of text (doc_id, pnum, x0, y0, x1, y1) instead of images, and know no kinds of regions but text.
BUILT = {
    "layout_detection": ("pagewright.operators.columns", "layout"),
    "reading_order": ("pagewright.operators.columns", "order"),
    "pdf_text": ("pagewright.sources.pdf", "text"),
    "pdf_outline": ("pagewright.sources.pdf", "outline"),
    "fix_encoding": ("pagewright.functions.text", "encoding_fixed"),
}

#: Columns without which what is built in can't do a stage.
FROM = {name: {"doc_id", "pnum", "x0", "y0", "x1", "y1"} for name in ("layout_detection", "reading_order")}


def plug(name: str, run: Callable[..., DataFrame]) -> None:
    """Use a function for a stage. It should load its model once per worker, inside an iterator UDF."""
    if name not in CONTRACTS:
        raise KeyError(f"no stage is called {name!r}")
    _PLUGGED[name] = run


def unplug(name: str) -> None:
    _PLUGGED.pop(name, None)


def run(name: str, *inputs: DataFrame, **options) -> DataFrame:
    """Run a stage that is plugged or built in; its result has to have the contract's columns."""
    contract = CONTRACTS[name]
    if name in _PLUGGED:
        stage = _PLUGGED[name]
    elif name in BUILT and FROM.get(name, set()) <= {c for df in inputs for c in df.columns}:
        stage = getattr(importlib.import_module(BUILT[name][0]), BUILT[name][1])
    else:
        raise NotAvailable(f"{name} needs {contract.needs}, which isn't here; see models.plug")
    out = stage(*inputs, **options)
    missing = {c.split()[0] for c in contract.gives.replace("array<struct<", "array<").split(", ")} - set(out.columns)
    if missing:
        raise ValueError(f"{name} has to give {sorted(missing)}")
    return out


def limit_boxes(boxes: DataFrame, most: int = 255) -> DataFrame:
    """The first boxes of each page, as many as an order model takes."""
    w = W.partitionBy("doc_id", "pnum").orderBy("box_idx")
    return boxes.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= most).drop("row")
