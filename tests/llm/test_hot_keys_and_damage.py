"""Sharding of keys and rows that repeat; archives with flipped bytes."""

import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.llm import common, sharding, warc


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_hot_keys_are_spread(spark, monkeypatch, block):
    """Half of the ids null, a quarter of the rows all alike: shards within 1 % of equal bytes, slots gapless."""
    monkeypatch.setattr(sharding, "BLOCK", block)
    n = 20_000
    i = F.col("i")
    rows = spark.range(n).select(F.col("id").alias("i")).select(F.when(i % 2 == 0, None).when(i % 4 == 1, 7).otherwise(i).alias("doc_id"), F.when(i % 4 == 1, "same").when(i % 4 == 3, F.repeat(F.lit("é"), (i % 5).cast("int"))).otherwise(F.concat(F.lit("t"), i.cast("string"))).alias("text"), F.lit("x").alias("n"), F.lit(1).alias("h"))
    got = sharding.shard(rows, 8).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in rows.collect())
    assert Counter((r.doc_id, r.size) for r in got) == want
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) < 1.01 * sum(size.values()) / 8 and min(size.values()) > 0.99 * sum(size.values()) / 8
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_no_python_in_the_plan(spark):
    plan = sharding.shard(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def archive(n=12):
    r = random.Random(1)
    return b"".join(warc.page_record(i, f"http://x/{i}", bytes(r.randrange(256) for _ in range(40 * i)), i - 1 if i % 3 == 2 else None, i % 3 == 2) for i in range(n))


def test_flipped_bytes_are_one_kind_of_error():
    body, r, bad = archive(), random.Random(2), 0
    for _ in range(3000):
        raw = bytearray(body)
        for _ in range(r.choice([1, 1, 3, 40])):
            raw[r.randrange(len(raw))] ^= 1 << r.randrange(8)
        if r.random() < 0.2:
            del raw[r.randrange(len(raw)) :]
        try:
            list(warc.read_records(io.BytesIO(bytes(raw)), payloads=True))
        except warc.WarcError:
            bad += 1
    assert bad > 2000


@pytest.mark.parametrize("change", [lambda x: x.replace(b"Content-Length: ", b"Content-Size: "), lambda x: x.replace(b"Content-Length: ", b"Content-Length: x"), lambda x: x.replace(b"Content-Length: ", b"Content-Length: -"), lambda x: x.replace(b"WARC-Type", b"WARC-\xff\xfe"), lambda x: b"WARC/1.1\r\n" + b"a: b\r\n" * 400_000])
def test_bad_headers(change):
    import gzip

    raw = change(gzip.decompress(warc.page_record(1, "u", b"abc", None, False)))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(gzip.compress(raw))))


def test_a_damaged_archive_is_a_row(spark):
    pages = spark.createDataFrame([(i, "u", "text " * i) for i in range(30)], "page_id long, url string, html string").repartition(3)
    folder = common.scratch(spark, "warc-test")
    names = sorted(r.path for r in warc.write(pages, folder).collect())
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{names[0]}")
    local = path.toUri().getPath()
    whole = Counter(r.record_type for r in warc.read(spark, folder).collect())
    assert whole["error"] == 0 and sum(whole.values()) == 30
    with open(local, "rb") as f:
        raw = f.read()
    assert [r["record_type"] for r in warc.read_records(io.BytesIO(raw))].count("response") > 5  # a member for each record, and nothing around them
    with open(local, "wb") as f:
        f.write(raw[: len(raw) * 2 // 3])
    rows = warc.read(spark, folder).collect()
    errors = [r for r in rows if r.record_type == "error"]
    assert [r.target_uri for r in errors] == [names[0]] and errors[0].error and 20 <= len(rows) < 31
