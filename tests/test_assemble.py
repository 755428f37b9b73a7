"""Documents from pages that arrive in any order: whole, late and stray ones, restarts, and equality with a batch."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.streaming import assemble, ingest

SCHEMA = "doc_id long, pnum int, n_pages int, text string, event_time timestamp"
START = datetime.datetime(2024, 1, 1)


def page(doc, pnum, n, minute=0, text=None):
    return (doc, pnum, n, f"{doc}.{pnum}" if text is None else text, START + datetime.timedelta(minutes=minute))


class Feed:
    """A folder of files, each a batch, and the documents that came out of them."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, sink=None):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        q = ingest.write(assemble.assemble(stream, "10 minutes", "5 minutes"), sink or ingest.by_batch(f"{self.path}/out"), f"{self.path}/checkpoint")
        q.awaitTermination()

    def out(self):
        return Counter((r.doc_id, r.text, r.n_pages, r.n_seen, r.status) for r in self.spark.read.parquet(f"{self.path}/out").collect())


def test_pages_in_any_order_and_a_restart(spark, tmp_path):
    r = random.Random(3)
    rows = [page(d, p, 4 + d % 3, minute=p % 3) for d in range(12) for p in range(4 + d % 3)]
    rows += [page(None, 0, 2), page(None, 1, 2), page(50, 1, 2, text=""), (50, None, 2, None, START), page(3, 1, 4, text="again")]
    want = Counter(tuple(x) for x in assemble.assemble_batch(spark.createDataFrame(rows[:-1], SCHEMA)).collect())
    again = rows.pop()
    r.shuffle(rows)
    feed = Feed(spark, tmp_path)
    at = rows.index(page(3, 1, 4, minute=1))
    rows.insert(at + 1, again)  # while the document is open, unless that page was its last
    for i in range(0, 48, 12):
        feed.put(rows[i : i + 12])
    feed.run()
    first = feed.out()
    assert 0 < sum(first.values()) < sum(want.values())
    for i in range(48, len(rows), 12):
        feed.put(rows[i : i + 12])
    feed.run()
    got = feed.out()
    assert {k: v for k, v in got.items() if k[4] == "whole"} == dict(want)
    assert sum(v for k, v in got.items() if k[4] != "whole") <= 1


def test_late_and_stray(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put([page(1, 2, 3), page(1, 0, 3), page(2, 0, 1), page(4, 0, None)])
    feed.put([page(3, 0, 2, minute=60), page(2, 0, 1, minute=56, text="too late for 2")])
    feed.put([page(3, 1, 2, minute=61)])  # rows come before timers in a batch, so that 1 and 4 are out after this one
    feed.put([page(1, 1, 3, minute=57, text="too late for 1")])
    feed.run()
    got = feed.out()
    assert got[(1, "1.0\n1.2", 3, 2, "late")] == 1 and got[(4, "4.0", None, 1, "late")] == 1
    assert got[(2, "2.0", 1, 1, "whole")] == 1 and got[(3, "3.0\n3.1", 2, 2, "whole")] == 1
    assert got[(2, "too late for 2", 1, 1, "stray")] == 1
    assert got[(1, "too late for 1", 3, 1, "stray")] == 1 and sum(got.values()) == 6


def test_a_failed_batch_comes_again(spark, tmp_path):
    """A sink that breaks once: after the restart every document is there once."""
    feed = Feed(spark, tmp_path)
    feed.put([page(1, 0, 2), page(2, 0, 1)])
    feed.put([page(1, 1, 2)])
    put, seen = ingest.by_batch(f"{tmp_path}/out"), []

    def broken(batch, number):
        if number == 1 and not seen:
            seen.append(number)
            raise RuntimeError("the sink is away")
        put(batch, number)

    with pytest.raises(Exception, match="the sink is away"):
        feed.run(broken)
    feed.run(broken)
    assert feed.out() == Counter({(1, "1.0\n1.1", 2, 2, "whole"): 1, (2, "2.0", 1, 1, "whole"): 1})


def test_chunk_counts_over_event_time(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put([page(1, 0, 1, m) for m in (1, 2, 59, 61)])
    feed.put([page(1, 0, 1, 180)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.write(assemble.counts(stream, width="1 hour"), ingest.by_batch(f"{tmp_path}/n"), f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/n").select(F.date_format("start", "HH").alias("h"), "n").collect()
    assert {(r.h, r.n) for r in got} == {("00", 3), ("01", 1)}


def test_batch_form_on_odd_rows(spark):
    rows = [page(1, 0, 5), page(1, 0, 5, minute=-1, text="earlier"), page(2, 0, 0), (3, 0, 1, None, None)]
    got = {r.doc_id: (r.text, r.status) for r in assemble.assemble_batch(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("earlier", "late"), 2: ("2.0", "late"), 3: ("", "whole")}
    assert assemble.assemble_batch(spark.createDataFrame([], SCHEMA)).collect() == []
