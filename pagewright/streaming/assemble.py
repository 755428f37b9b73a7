"""Documents put together from pages that arrive in any order, over any number of batches.

A document's pages are kept as state under its id until all are there; then it comes out, once. A document that isn't
whole when no page of it came for `wait` of event time comes out as it is, by a timer; so does one that never says how
many pages it has. A page that comes when its document is out already is a row of its own, marked `stray`, so that
nothing is lost in silence. State is in RocksDB, one entry for each page, so that a page costs a write of its own and
not one of its document; only when a document comes out is it read as a whole.

Event time comes from a column with a watermark. A timer fires when the watermark passes it; rows that are older than
the watermark are dropped by Spark, as they are everywhere. What came out is remembered until its timer fires again.

Defined results: a page that arrives again is ignored while its document is open, and stray afterwards; null text is
kept as an empty page; pages without a number stand first; a null document id is a document; a count below the pages
that are there counts as whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Spark starts a Python process of its own on the driver for processors, which knows no packages but installed ones.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT = "doc_id long, text string, n_pages int, n_seen int, status string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_NUMBER = -(1 << 31)


class Assembler(StatefulProcessor):
    """Pages of one document, kept by number, with what is known of it: pages expected and seen, its timer, and whether
    it is out."""

    def __init__(self, wait_ms: int, separator: str) -> None:
        self.wait_ms, self.separator = wait_ms, separator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "pnum int", "text string")
        self.about = handle.getValueState("about", "expected int, seen int, timer long, out boolean")

    def _row(self, key, text: str, expected: int, seen: int, status: str) -> pd.DataFrame:
        doc = pd.array([key[0]], "Int64")
        return pd.DataFrame({"doc_id": doc, "text": [text], "n_pages": pd.array([expected or None], "Int32"), "n_seen": pd.array([seen], "Int32"), "status": [status]})

    def _whole(self, key, expected: int, seen: int, status: str) -> pd.DataFrame:
        """The document's row; its pages leave the state."""
        texts = [text for _, text in sorted((k[0], v[0]) for k, v in self.pages.iterator())]
        self.pages.clear()
        return self._row(key, self.separator.join(texts), expected, seen, status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected, seen, timer, out = self.about.get() if self.about.exists() else (0, 0, 0, False)
        latest = 0
        for batch in rows:
            for pnum, n, text, at in zip(batch["pnum"], batch["n_pages"], batch["text"], batch["event_time"]):
                text = "" if pd.isna(text) else text
                latest = max(latest, 0 if pd.isna(at) else int(at.timestamp() * 1000))
                if out:
                    yield self._row(key, text, expected, 1, "stray")
                    continue
                number = (NO_NUMBER if pd.isna(pnum) else int(pnum),)
                if not self.pages.containsKey(number):
                    self.pages.updateValue(number, (text,))
                    seen += 1
                expected = max(expected, 0 if pd.isna(n) else int(n))
        if not out and 0 < expected <= seen:
            yield self._whole(key, expected, seen, "whole")
            out = True
        if (due := max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait_ms) > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.about.update((expected, seen, timer, out))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.about.exists():
            return
        expected, seen, timer, out = self.about.get()
        if out:  # long enough ago: forget it
            self.about.clear()
            return
        yield self._whole(key, expected, seen, "late")
        due = timerValues.getCurrentWatermarkInMs() + self.wait_ms
        self.handle.registerTimer(due)
        self.about.update((expected, seen, due, True))

    def close(self) -> None: ...


def assemble(pages: DataFrame, wait: str = "10 minutes", delay: str = "10 minutes", separator: str = "\n") -> DataFrame:
    """Documents (doc_id, text, n_pages, n_seen, status) from a stream of pages (doc_id, pnum, n_pages, text, event_time).

    `delay` is how late a page may be behind the newest one of the stream, `wait` how long a document may stand still."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ms = spark.sql(f"select unix_millis(timestamp_seconds(0) + interval {wait})").first()[0]
    rows = pages.select(F.col("doc_id").cast("long"), F.col("pnum").cast("int"), F.col("n_pages").cast("int"), F.col("text").cast("string"), F.col("event_time").cast("timestamp"))
    by = rows.withWatermark("event_time", delay).groupBy("doc_id")
    return by.transformWithStateInPandas(Assembler(ms, separator), OUT, "append", "EventTime")


def assemble_batch(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """The same of a table that is all there: every document is whole, or late."""
    first = pages.groupBy("doc_id", F.coalesce("pnum", F.lit(NO_NUMBER)).alias("p")).agg(F.min_by(F.coalesce("text", F.lit("")), "event_time").alias("text"), F.max("n_pages").alias("n"))
    got = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "text"))).alias("t"), F.max("n").cast("int").alias("n_pages"), F.count(F.lit(1)).cast("int").alias("n_seen"))
    status = F.when((F.col("n_pages") > 0) & (F.col("n_pages") <= F.col("n_seen")), "whole").otherwise("late")
    return got.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), separator).alias("text"), "n_pages", "n_seen", status.alias("status"))


def counts(chunks: DataFrame, time: str = "event_time", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, n) chunks of each window of event time of a stream, once the watermark has passed it."""
    by = chunks.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
