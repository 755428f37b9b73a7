"""Sharding by fixed virtual slots.

Each record hashes into one of a fixed number of virtual slots. Bytes are summed per slot, and a small table
says to which shard each slot belongs. The table has versions: rebalancing edits it and writes the next version,
and records move only if their slot's entry changed. All of it is DataFrame operations.

A record's slot comes from its key. A slot with many records and more than its share of the bytes, as a key that occurs
often makes it, is split: its records go to slots by key, size and checksum, and copies that are equal in all of these
to consecutive slots. Equal records are counted first, so that no key, however often it occurs, fills a slot or a task.

Defined results: a null text has no bytes (size 1, checksum 0 of the empty string); a null id hashes like the word
"null"; repeated rows are separate records with positions of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Virtual slots; fixed for the life of a dataset. The slot table has as many rows, whatever the input.
VIRTUAL_SLOTS = 4096
#: Copies of one record that a task makes.
BLOCK = 1 << 16
#: A slot is split if it has more records than these, and more bytes than a shard's divided by `PARTS`.
RECORDS, PARTS = 64, 256


def virtual_slot(key: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    """Slot of a key: the first 28 bits of the MD5 of its text, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % slots).cast("int")


def slot_totals(records: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Rows and bytes of every virtual slot (vslot, n_rows, n_bytes), slots without records included."""
    spark = records.sparkSession
    got = records.groupBy("vslot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
    every = spark.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(got, "vslot", "left").na.fill(0, ["n_rows", "n_bytes"])


def balanced_map(totals: DataFrame, shards: int) -> DataFrame:
    """First version of the slot map: slots by falling bytes, each to the shard with the fewest bytes so far.

    The fold runs over one array of `VIRTUAL_SLOTS` entries, a constant size."""
    entries = F.sort_array(F.collect_list(F.struct((-F.col("n_bytes")).alias("b"), F.col("vslot").alias("v"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(acc: Column, x: Column) -> Column:
        best = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(acc["loads"], lambda y, i: y + F.when(i == best, -x["b"]).otherwise(F.lit(0).cast("long")))
        return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array(best)).alias("to"))

    done = totals.agg(entries.alias("e")).select("e", F.aggregate("e", start, put)["to"].alias("to"))
    pairs = done.select(F.explode(F.arrays_zip(F.col("e"), F.col("to"))).alias("p"))
    return pairs.select(F.lit(1).alias("version"), F.col("p.e.v").alias("vslot"), F.col("p.to").alias("shard"))


def rebalance(slot_map: DataFrame, totals: DataFrame, old: int, shards: int) -> DataFrame:
    """The next version of the map for more shards (from `old` to `shards`): slots move only into shards that are new.

    Every old shard gives up slots, in the order of their ids, until it has given its share of bytes; the new shards
    take them in turn."""
    by = W.partitionBy("shard").orderBy("vslot")
    run = slot_map.join(totals, "vslot").withColumn("given", F.sum("n_bytes").over(by)).withColumn("own", F.sum("n_bytes").over(W.partitionBy("shard")))
    gone = F.col("given") <= F.col("own") * (shards - old) / F.lit(shards)
    new = F.when(gone, F.lit(old) + F.col("vslot") % max(shards - old, 1)).otherwise(F.col("shard"))
    return run.select((F.col("version") + 1).alias("version"), "vslot", new.cast("int").alias("shard"))


def store_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write a version of the map below `path` and read it back. A version is never written twice."""
    where = f"{path}/version={version}"
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(where)
    return slot_map.sparkSession.read.parquet(where).withColumn("version", F.lit(version))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest unless one is named."""
    every = spark.read.parquet(path)
    at = F.lit(version) if version is not None else F.lit(every.agg(F.max("version")).first()[0])
    return every.filter(F.col("version") == at)


def copies(groups: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Rows with their slot (vslot) from rows with a count `n`, a slot `h`, and whether the slot is split: then copy j is in
    slot (h + j) modulo the slots. Counts of more than `BLOCK` are cut first and dealt out."""

    def spread(df: DataFrame, first: Column, count: Column) -> DataFrame:
        df = df.withColumn("j", F.explode(F.sequence(first, first + count - 1)))
        at = F.when(F.col("split"), F.pmod(F.col("h") + F.col("j"), F.lit(slots))).otherwise(F.col("h"))
        return df.withColumn("vslot", at.cast("int")).drop("j", "n", "h", "split")

    few = spread(groups.filter(F.col("n") <= BLOCK), F.lit(0).cast("long"), F.col("n"))
    many = groups.filter(F.col("n") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))))
    many = many.repartition(F.xxhash64("h", "block"))
    begin = F.col("block") * BLOCK
    return few.unionByName(spread(many, begin, F.least(F.lit(BLOCK).cast("long"), F.col("n") - begin)).drop("block"))


def shard(docs: DataFrame, shards: int = 8, slots: int = VIRTUAL_SLOTS, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Put all records into shards of nearly equal bytes.

    Returns key, size, text_crc32, vslot, shard, slot (position within the shard, gapless from 0) and map_version."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    path = path or common.scratch(spark, "slot-map")
    rows = docs.select(F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    groups = rows.groupBy(key, "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    groups.withColumn("h", virtual_slot(F.col(key), slots).cast("long")).write.mode("errorifexists").parquet(f"{path}-records")
    groups = spark.read.parquet(f"{path}-records")
    loads = groups.groupBy("h").agg(F.sum("n").alias("records"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    # a row for each slot at most
    share = loads.withColumn("all", F.sum("bytes").over(W.partitionBy(F.lit(0))))
    hot = share.filter((F.col("records") > RECORDS) & (F.col("bytes") * (shards * PARTS) > F.col("all"))).select("h", F.lit(True).alias("split"))
    groups = groups.join(F.broadcast(hot), "h", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), "size", "text_crc32")
    records = copies(groups.withColumn("h", F.when(F.col("split"), virtual_slot(name, slots).cast("long")).otherwise(F.col("h"))), slots)
    totals = slot_totals(records, slots)
    totals.write.mode("errorifexists").parquet(f"{path}-totals")  # both the map and the offsets come from it
    totals = spark.read.parquet(f"{path}-totals")
    slot_map = store_map(balanced_map(totals, shards), path, 1)
    # Where a slot's records begin in its shard: rows of the slots before it. The table has VIRTUAL_SLOTS rows.
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    placed = slot_map.join(totals.select("vslot", "n_rows"), "vslot").select("vslot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("begin"))
    # Within a slot records are numbered by id; slots are hashed, so that no partition of this window stands out.
    inside = W.partitionBy("vslot").orderBy(F.col(key), "text_crc32", "size")
    numbered = records.withColumn("n", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(placed), "vslot").select(key, "size", "text_crc32", "vslot", "shard", (F.col("begin") + F.col("n")).cast("long").alias("slot"), F.col("version").alias("map_version"))
