"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Text is lower-cased in A-Z only; words are maximal runs of digits, letters and non-ASCII characters. A window is
`n` consecutive words of an item; an item of fewer words, but not none, is one window. Document windows are hashed
and looked up; each hit is verified word by word, and the words of every verified occurrence are marked.

Defined results: null and wordless texts have no words and no hits; wordless or null items have no windows; repeated
items count once for each item_id; the windows of items without an id hit words, and no id is named for them; an empty
benchmark hits nothing; every row is judged by its own text, whatever its key is and whatever size the benchmark has;
other columns are ignored by `scan` and kept by `remove_documents` and `remove_spans`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Largest part of the benchmark that is sent to the executors at once, in bytes of what is made of it (see `cost`);
#: more goes in several scans.
SLICE_BYTES = 128 << 20
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to a-z; what isn't part of a word to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as bytes: everything else became a space, and bytes split at ASCII white space alone."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def cost(data: bytes) -> int:
    """Bytes of memory that an item of the benchmark takes in `Windows`, at most: its text, and for each word a hash, an
    offset, and a window's hash, place, range of items and item."""
    return len(data) + 64 + 48 * (len(data.translate(_TABLE).split()))


class Windows:
    """The benchmark's windows in sorted arrays. `buffer` holds all words, a space after each, from `offset` on; words of
    an item follow each other. By length of windows: the sorted hashes of different windows, where each begins, and the
    items that it is in, `of[first[k] : first[k + 1]]`."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = WINDOW) -> None:
        words = [words_of(text) for _, text in items]
        self.buffer = b"".join(w + b" " for ws in words for w in ws)
        lengths = np.fromiter((len(w) + 1 for ws in words for w in ws), np.int64)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, len(lengths))
        self.names = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        counts = np.array([len(ws) for ws in words], np.int64)
        begin = np.cumsum(counts) - counts
        own = np.array([number.get(i, -1) for i, _ in items], np.int64)
        self.known = np.unique(flat)
        self.sizes: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({min(n, c) for c in counts.tolist() if c}):
            some = np.flatnonzero((counts >= n) if size == n else (counts == size))
            each = counts[some] - size + 1
            at = np.repeat(begin[some] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            self.sizes[size] = self._entries(flat, at, np.repeat(own[some], each), size)

    def _entries(self, flat: np.ndarray, at: np.ndarray, item: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        h = self.rolled(flat, at, size)
        order = np.lexsort((item, h))
        h, at, item = h[order], at[order], item[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        lead = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = np.ones(len(at), bool)
        for i in range(size):
            same &= flat[at + i] == flat[lead + i]
        if not same.all():  # different windows of one hash: each is an entry of its own
            numbers: dict[bytes, int] = {}
            key = np.array([numbers.setdefault(self._window(p, size), len(numbers)) for p in at.tolist()])
            order = np.lexsort((item, key, h))
            h, at, item, key = h[order], at[order], item[order], key[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
        entry = np.cumsum(new) - 1
        kept = np.flatnonzero((item >= 0) & np.concatenate([[True], (entry[1:] != entry[:-1]) | (item[1:] != item[:-1])]))
        first = np.searchsorted(entry[kept], np.arange(entry[-1] + 2))
        return h[new], at[new], first, item[kept].astype(np.int32)

    def _window(self, p: int, size: int) -> bytes:
        return self.buffer[self.offset[p] : self.offset[p + size]]

    @staticmethod
    def rolled(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Polynomial hash modulo 2**64 of the `size` words from each place."""
        h = np.zeros(len(at), np.uint64)
        for i in range(size):
            h = h * _STEP + words[at + i]
        return h

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """For each word whether it lies in an occurrence of a window, and the items with an id that occur."""
        hit, found = np.zeros(len(words), bool), set()
        if not words or not self.sizes:
            return hit, found
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        known = self.known[np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)] == ids
        if not known.any():
            return hit, found
        known = np.concatenate([[0], np.cumsum(known)])
        for size, (hashes, places, first, of) in self.sizes.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else ()  # only windows of known words can hit
            if not len(at):
                continue
            h = self.rolled(ids, at, size)
            k = np.searchsorted(hashes, h)
            there = np.flatnonzero(hashes[np.minimum(k, len(hashes) - 1)] == h)
            entries = set()
            for i, e, value in zip(at[there].tolist(), k[there].tolist(), h[there]):
                window = b" ".join(words[i : i + size]) + b" "
                while e < len(hashes) and hashes[e] == value:
                    if self._window(places[e], size) == window:  # the check of the hit, word by word
                        hit[i : i + size] = True
                        entries.add(e)
                        break
                    e += 1
            for e in entries:
                found.update(self.names[x] for x in of[first[e] : first[e + 1]].tolist())
        return hit, found


def spans(hit: np.ndarray) -> list[list[int]]:
    """Runs of hit words as [first, last + 1]."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _slices(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in parts whose windows take at most `limit` bytes (a larger item is a part of its own)."""
    part, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        more = cost((row[1] or "").encode("utf-8", "surrogatepass"))
        if part and size + more > limit:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += more
    if part:
        yield part


SCHEMA = "{key} {kind}, n_words long, n_hit long, item_ids array<string>, hit_spans array<array<int>>"


def _scan_part(docs: DataFrame, windows, key: str, text: str) -> DataFrame:
    def run(batches):
        common.only("decontam")
        w = windows.value
        for b in batches:
            out = [[], [], [], []]
            for t in b.column(1).to_pylist():
                words = words_of(t)
                hit, found = w.hits(words)
                for x, v in zip(out, (len(words), int(hit.sum()), sorted(found), spans(hit))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(pa.list_(pa.int32())))], [key, "n_words", "n_hit", "item_ids", "hit_spans"])

    return docs.select(key, text).mapInArrow(run, SCHEMA.format(key=key, kind=docs.schema[key].dataType.simpleString()))


#: Names that the rows of a table get while it is scanned part by part.
ROW = "row_of_scan"


def _parts(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, n: int, slice_bytes: int) -> list:
    sc = common.ship(docs.sparkSession).sparkContext
    return [sc.broadcast(Windows(x, n)) for x in _slices(benchmark, item, item_text, slice_bytes)] or [sc.broadcast(Windows([], n))]


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, fixed by a checkpoint: keys may repeat or be null."""
    return common.keep(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _united(rows: DataFrame, parts: list, text: str) -> DataFrame:
    """ROW, n_words, n_hit, item_ids, hit_spans of numbered rows, from the scans of all parts."""
    every = None
    for p in parts:
        one = _scan_part(rows.select(ROW, text), p, ROW, text)
        every = one if every is None else every.unionByName(one)
    by = every.groupBy(ROW).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("item_ids")).alias("i"), F.sort_array(F.flatten(F.collect_list("hit_spans"))).alias("s"))
    # Sorted spans are united in one fold; touching ones too, as runs of hit words do.
    united = F.expr("aggregate(s, cast(array() as array<array<int>>), (a, x) -> if(size(a) > 0 and element_at(a, -1)[1] >= x[0], concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(element_at(a, -1)[1], x[1])))), concat(a, array(x))))")
    by = by.select(ROW, "n_words", F.sort_array(F.array_distinct("i")).alias("item_ids"), united.alias("hit_spans"))
    return by.withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (a, x) -> a + x[1] - x[0])"))


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: key, n_words, n_hit, item_ids (sorted), hit_spans (runs of hit words, [first, end)).

    A benchmark whose windows take up to `slice_bytes` is one scan without a shuffle. A larger one is scanned part by
    part, so that what is broadcast stays bounded, and the parts' spans are united by the row's number."""
    parts = _parts(docs, benchmark, item, item_text, n, slice_bytes)
    if len(parts) == 1:
        return _scan_part(docs, parts[0], key, text)
    rows = _numbered(docs.select(key, text))
    return rows.select(ROW, key).join(_united(rows, parts, text), ROW).select(key, "n_words", "n_hit", "item_ids", "hit_spans")


def contaminated(share: int = 20) -> F.Column:
    """At least one of `share` words is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: int = 20, item: str = "item_id", item_text: str = "text", n: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows that are not contaminated, with all their columns; each row is judged by its own text.

    With a benchmark of one part this is a filter in one pass; a larger one needs the united spans, by the row's number."""
    parts = _parts(docs, benchmark, item, item_text, n, slice_bytes)
    if len(parts) > 1:
        rows = _numbered(docs)
        return rows.join(_united(rows, parts, text).filter(contaminated(share)).select(ROW), ROW, "left_anti").select(*docs.columns)
    windows = parts[0]

    def run(batches):
        common.only("decontam")
        w = windows.value
        for b in batches:
            keep = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                words = words_of(t)
                hit = int(w.hits(words)[0].sum())
                keep.append(not (hit > 0 and share * hit >= len(words)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cut_text(text: str | None, runs: list[list[int]]) -> str:
    """The text without the characters from the first to the last word of each run."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    out, last = [], 0
    for a, b in runs or []:
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All rows and columns, each text without its hit spans."""
    parts = _parts(docs, benchmark, item, item_text, n, slice_bytes)
    if len(parts) > 1:
        rows = _numbered(docs)
        hits = _united(rows, parts, text).filter("n_hit > 0").select(F.col(ROW).alias("hit_row"), "hit_spans")
        cut = F.udf(cut_text, "string", useArrow=True)
        both = rows.join(hits, F.col(ROW) == F.col("hit_row"), "left")
        return both.withColumn(text, F.when(F.col("hit_spans").isNotNull(), cut(F.col(text), F.col("hit_spans"))).otherwise(F.col(text))).select(*docs.columns)
    windows = parts[0]

    def run(batches):
        common.only("decontam")
        w = windows.value
        for b in batches:
            i = b.schema.get_field_index(text)
            texts = []
            for t in b.column(i).to_pylist():
                hit = w.hits(words_of(t))[0]
                texts.append(cut_text(t, spans(hit)) if hit.any() else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == i else b.column(j) for j in range(b.num_columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()
