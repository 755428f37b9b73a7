"""CSV files of any size as chunks: byte ranges read side by side, with the rows that `csv.read_exact` gives.

A line end inside of quotes doesn't end a record, so that a range doesn't know by itself where records begin. Each range
is read from both states, outside and inside of quotes, and says how it ends for each: that is a function of two values,
and functions put together give the state at which every range begins. The functions are one row for each range; the
lines between them never leave their task. Records that go over the border of ranges are put together from their parts.

Types count for how a cell is shown (`1` becomes `1.0` beside a missing one), and belong to whole columns: every piece of
records says what it saw, and is read again with the columns' types.

Ranges are Spark's own splits of the text source (`spark.sql.files.maxPartitionBytes`). A record must fit a task, and so
must a piece of about `PIECE` bytes; files needn't. Rows of a file are numbered by sums over its pieces.

Defined results: a file without records, with an encoding that doesn't fit, with a quote that is never closed, or with a
record of more than `RECORD` bytes that crosses a border is one chunk of type `error`; blank lines and rows with too many
cells have none; a file without bytes has none. Encodings must write line ends, quotes and the separator as ASCII does
(UTF-16 doesn't; `read_exact` takes it).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.document import chunk_id
from ..session import scratch
from . import binary

#: Bytes of whole records that are parsed together, and of a record that crosses borders at most.
PIECE, RECORD = 1 << 20, 1 << 28
#: Ranges whose states are sent to all tasks, 40 bytes each; more are taken in parts, by file.
RANGES = 1 << 20


def ends_inside(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """Whether a line ends inside of quotes. A quote opens a field only at its beginning; two inside of one are a quote."""
    if b'"' not in line:
        return inside
    # s: at the beginning of a field, i: within a plain one, q: within quotes, e: behind a quote that may have closed them
    state = "q" if inside else "s"
    for k, part in enumerate(line.split(b'"')):
        if k:
            state = {"s": "q", "e": "q", "q": "e", "i": "i"}[state]
        if part and state != "q":
            state = "s" if part[-1:] in (sep, b"\r") else "i"
    return state == "q"


def records(raw: bytes, sep: bytes = b",") -> Iterator[bytes]:
    """The records of a text that begins with one."""
    at = start = 0
    inside = False
    while at < len(raw):
        end = raw.find(b"\n", at) + 1 or len(raw)
        inside = ends_inside(raw[at:end].rstrip(b"\n"), inside, sep)
        at = end
        if not inside:
            yield raw[start:end]
            start = end
    if start < len(raw):
        yield raw[start:]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block (where its range begins) and value of every line, in order within a task. Values are the file's bytes."""
    got = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    file = F.regexp_replace(F.col("_metadata.file_path"), r"^(\w+):///", "$1:/")
    file = F.try_url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    return got.select(file.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple[tuple, list[bytes]]]:
    """((path, block, ...), some of its lines), in order; a block may come in several lists."""
    for b in batches:
        key, some = None, []
        for *new, value in zip(*(c.to_pylist() for c in b.columns)):
            if new != key:
                if some:
                    yield tuple(key), some
                key, some = new, []
            some.append(value)
        if some:
            yield tuple(key), some


def summaries(found: DataFrame, sep: str = ",") -> DataFrame:
    """(path, block, f0, f1, begins): how a range ends if it begins outside, or inside, of quotes, and whether a record
    begins in it in the latter case."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f0, f1, begins = None, False, True, False
        rows: list[tuple] = []
        for new, some in _blocks(batches):
            if new != key:
                if key:
                    rows.append((*key, f0, f1, begins))
                key, f0, f1, begins = new, False, True, False
            for line in some:
                begins = begins or not f1  # this line begins outside
                f0, f1 = ends_inside(line, f0, mark), ends_inside(line, f1, mark)
        if key:
            rows.append((*key, f0, f1, begins))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))], ["path", "block", "f0", "f1", "begins"])

    return found.mapInArrow(run, "path string, block long, f0 boolean, f1 boolean, begins boolean")


def states(ranges: DataFrame) -> DataFrame:
    """(path, block, inside, owner, unclosed) from `summaries`: the state at which each range begins, the range in which
    the record that is open there began, and whether the file ends inside of quotes.

    A range's function forgets the state, keeps it, or turns it round. The state is what the last one that forgot says,
    turned as often as others turned it since."""
    by = W.partitionBy("path").orderBy("block")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    turns = F.sum(F.when(F.col("f0") & ~F.col("f1"), 1).otherwise(0)).over(by)
    r = ranges.withColumn("turns", turns)
    forgot = F.when(F.col("f0") == F.col("f1"), F.struct("f0", "turns"))
    r = r.withColumn("last", F.last(forgot, ignorenulls=True).over(before)).withColumn("so_far", F.coalesce(F.lag("turns").over(by), F.lit(0)))
    turned = (F.col("so_far") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    r = r.withColumn("inside", F.coalesce("last.f0", F.lit(False)) != turned)
    ends = F.when(F.col("inside"), F.col("f1")).otherwise(F.col("f0"))
    own = F.when(ends & (~F.col("inside") | F.col("begins")), F.col("block"))
    r = r.withColumn("ends", ends).withColumn("owner", F.last(own, ignorenulls=True).over(before))
    everything = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return r.select("path", "block", "inside", "owner", F.last("ends").over(everything).alias("unclosed"))


def _cut(found: DataFrame, begins: DataFrame, sep: str) -> DataFrame:
    """(path, block, k, part, text): pieces of whole records (part 0), and parts of records that cross borders, under the
    range in which they began."""
    mark = sep.encode()
    known = F.broadcast(begins.filter(~F.col("unclosed")).select("path", "block", "inside", "owner"))
    joined = found.join(known, ["path", "block"]).select("path", "block", "inside", F.coalesce("owner", F.lit(-1)).alias("owner"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        key, open_, head, k, piece, record, long = None, False, False, 0, [], [], 0

        def put(owner: int, part: int, text: list[bytes]) -> None:
            nonlocal k, size
            if text:
                raw = b"".join(text)
                out.append((key[0], owner, k, part, raw))
                k, size = k + 1, size + len(raw)

        def close() -> None:
            """A range is over: what is open goes on in the next one."""
            nonlocal piece, record
            if head:
                put(key[3], 1 + key[1], record)
            else:
                put(key[1], 0, piece)
                put(key[1], 1 + key[1], record)
            piece, record = [], []

        def batch() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out))
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["path", "block", "k", "part", "text"])
            out.clear()
            size = 0
            return got

        for new, some in _blocks(batches):
            if new != key:
                if key:
                    close()
                key, open_, head, k, long = new, new[2], new[2], 0, 0
            for line in some:
                record.append(line + b"\n")
                long += len(line)
                open_ = ends_inside(line, open_, mark)
                if not open_:
                    if head:
                        put(key[3], 1 + key[1], record)
                        head = False
                    else:
                        piece += record
                    record = []
                if long > PIECE:
                    if head:
                        put(key[3], 1 + key[1], record)
                        record = []
                    else:
                        put(key[1], 0, piece)
                        piece = []
                    long = 0
            if size > 16 * PIECE:
                yield batch()
        if key:
            close()
        if out:
            yield batch()

    return joined.mapInArrow(run, "path string, block long, k long, part long, text binary")


def _whole(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces with the records that cross borders put together, and the files in which one is too long."""
    crossing = parts.filter("part > 0")
    long = crossing.groupBy("path", "block").agg(F.sum(F.length("text")).alias("n")).filter(F.col("n") > RECORD).select("path").distinct()

    def join(key, table):
        rows = sorted(table.select(["part", "k", "text"]).to_pylist(), key=lambda r: (r["part"], r["k"]))
        # behind all whole records of the range
        return pa.table({"path": [key[0].as_py()], "block": [key[1].as_py()], "k": pa.array([1 << 40], pa.int64()), "text": pa.array([b"".join(r["text"] for r in rows)], pa.binary())})

    joined = crossing.join(long, "path", "left_anti").groupBy("path", "block").applyInArrow(join, "path string, block long, k long, text binary")
    return parts.filter("part = 0").join(long, "path", "left_anti").select("path", "block", "k", "text").unionByName(joined), long


def _firsts(pieces: DataFrame, sep: str) -> DataFrame:
    """(path, head, row): the header and the first row of every file, as bytes."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, block, k, text in zip(*(c.to_pylist() for c in b.columns)):
                n = 0
                for record in records(text, mark):
                    if record.strip(b" \t\r\n"):
                        rows.append((path, block, k, n, record))
                        n += 1
                        if n == 2:
                            break
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["path", "block", "k", "i", "record"])

    some = pieces.select("path", "block", "k", "text").mapInArrow(run, "path string, block long, k long, i long, record binary")
    some = some.select("path", F.struct("block", "k", "i").alias("at"), "record")
    head = some.groupBy("path").agg(F.min("at").alias("first"), F.min_by("record", "at").alias("head"))
    row = some.join(head, "path").filter(F.col("at") > F.col("first")).groupBy("path").agg(F.min_by("record", "at").alias("row"))
    return head.join(row, "path", "left").select("path", "head", F.coalesce("row", F.lit(b"")).alias("row"), F.col("first.block").alias("head_block"), F.col("first.k").alias("head_k"))


def _parse(head: bytes, row: bytes, text: bytes, is_head: bool, encoding: str, sep: str, dtype=None) -> pd.DataFrame:
    """A piece's rows. The header and the first row stand before it, as they decide how many columns a row may have."""
    if is_head:
        text = text[text.index(head) + len(head) :]
    raw = io.BytesIO(b"".join(x if x.endswith(b"\n") else x + b"\n" for x in (head, row, text) if x))
    got = pd.read_csv(raw, on_bad_lines="skip", encoding=encoding, sep=sep, low_memory=False, dtype=dtype)
    return got.iloc[1:] if row else got


def kind(column: pd.Series) -> str:
    """What a piece of a column holds: empty, bool, int, float or text."""
    some = column.dropna()
    if not len(some):
        return "empty"
    if pd.api.types.is_bool_dtype(some) or all(isinstance(x, bool) for x in some):
        return "bool"
    return "int" if pd.api.types.is_integer_dtype(some) else "float" if pd.api.types.is_float_dtype(some) else "text"


def column_type(kinds: list[str], missing: bool) -> str | None:
    """The type of a column from what its pieces hold; None where a piece's own is right."""
    seen = set(kinds) - {"empty"}
    if "text" in seen or ("bool" in seen and len(seen) > 1):
        return "str"
    if "float" in seen or (missing and "int" in seen):
        return "float64"
    return None


def read(spark: SparkSession, path: str, encoding: str = "utf-8-sig", sep: str = ",", source_column: str | None = None) -> DataFrame:
    """Chunks of CSV files, one for each row, as `csv.read_exact` gives them."""
    out = scratch(spark, "csv")

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    found = lines(spark, path)
    begins = store(states(summaries(found, sep)), "ranges")
    parts = -(-begins.count() // RANGES) or 1
    some = lambda df, i: df.filter(F.pmod(F.xxhash64("path"), F.lit(parts)) == i) if parts > 1 else df
    cut = _cut(some(found, 0), some(begins, 0), sep)
    for i in range(1, parts):
        cut = cut.unionByName(_cut(some(found, i), some(begins, i), sep))
    pieces, long = _whole(store(cut, "cut"))
    pieces = store(pieces, "pieces")
    firsts = store(_firsts(pieces, sep), "firsts")
    known = pieces.join(firsts, "path").select("path", "block", "k", "text", "head", "row", ((F.col("block") == F.col("head_block")) & (F.col("k") == F.col("head_k"))).alias("is_head"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path_, block, k, text, head, row, is_head in b.itertuples(index=False):
                try:
                    df = _parse(head, row, text, is_head, encoding, sep)
                    if source_column and source_column not in df.columns:
                        raise ValueError(f"there is no column {source_column!r}")
                    rows.append((path_, block, k, -1, "rows", len(df), None))
                    rows += [(path_, block, k, i, kind(df.iloc[:, i]), int(df.iloc[:, i].isna().sum()), None) for i in range(df.shape[1])]
                except (ValueError, pd.errors.ParserError) as e:
                    rows.append((path_, block, k, -1, "error", 0, binary.NO_ENCODING if isinstance(e, UnicodeDecodeError) else str(e)))
            yield pd.DataFrame(rows, columns=["path", "block", "k", "i", "kind", "n", "error"])

    seen = store(known.mapInPandas(look, "path string, block long, k long, i int, kind string, n long, error string"), "seen")
    types = seen.filter("i >= 0").groupBy("path", "i").agg(F.collect_set("kind").alias("kinds"), (F.sum("n") > 0).alias("missing"))
    types = types.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "kinds", "missing"))).alias("types"))
    # where each piece's rows begin: sums of a file's ranges, and within a range
    counts = seen.filter("kind = 'rows'").select("path", "block", "k", "n")
    ranges = counts.groupBy("path", "block").agg(F.sum("n").alias("n"))
    base = ranges.select("path", "block", (F.sum("n").over(W.partitionBy("path").orderBy("block")) - F.col("n")).alias("base"))
    begin = F.sum("n").over(W.partitionBy("path", "block").orderBy("k")) - F.col("n")
    begin_of = counts.select("path", "block", "k", begin.alias("begin")).join(base, ["path", "block"]).select("path", "block", "k", (F.col("base") + F.col("begin")).alias("begin"))
    bad = seen.filter("kind = 'error'").groupBy("path").agg(F.min("error").alias("error"))
    good = known.join(bad, "path", "left_anti").join(types, "path").join(begin_of, ["path", "block", "k"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, text, head, row, is_head, types_, begin_ in b.itertuples(index=False):
                names = _parse(head, row, b"", False, encoding, sep).columns
                dtype = {names[t["i"]]: want for t in types_ if (want := column_type(list(t["kinds"]), t["missing"]))}
                df = _parse(head, row, text, is_head, encoding, sep, dtype)
                content = [";".join(f"{str(c).strip()}: {str(v).strip()}" for c, v in r.items()) for _, r in df.iterrows()]
                named = [str(v) for v in df[source_column]] if source_column else [""] * len(df)
                if content:
                    yield pd.DataFrame({"path": path_, "index": range(begin_, begin_ + len(df)), "chunk_type": "text", "content": content, "source": named})

    kinds = "path string, index int, chunk_type string, content string, source string"
    chunks = good.select("path", "text", "head", "row", "is_head", "types", "begin").mapInPandas(rows, kinds)

    def errors(df: DataFrame, reason: Column) -> DataFrame:
        return df.select("path", F.lit(0).alias("index"), F.lit("error").alias("chunk_type"), reason.alias("content"), F.col("path").alias("source"))

    unclosed = begins.filter("unclosed").select("path").distinct()
    read_ = begins.select("path").distinct()
    none = read_.join(firsts, "path", "left_anti").join(unclosed, "path", "left_anti").join(long, "path", "left_anti")
    every = chunks.unionByName(errors(bad, F.col("error"))).unionByName(errors(unclosed, F.lit("a quote is never closed"))).unionByName(errors(long, F.lit("a record is too long"))).unionByName(errors(none, F.lit("No columns to parse from file")))
    every = every.withColumn("doc_id", F.xxhash64("path"))
    return every.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("index"))).select(*binary.CHUNK_COLUMNS)
