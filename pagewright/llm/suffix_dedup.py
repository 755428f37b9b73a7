"""Exact removal of repeated passages with suffix arrays.

A byte goes if a 400-byte string that covers it also starts anywhere else; or, with another `Unit`, a word goes if a run
of so many words that covers it does. The corpus is dealt so that equal windows meet: each window belongs to its
smallest gram (the leftmost of equals; 32 bytes or 8 words), which depends on the window alone. Neighbouring windows with the same gram make a segment of less than two windows. Segments with the same
gram form a group; equal segments are counted, and a group whose segments are all equal needs no sorting. For every
other group one copy of each different segment is fetched, cut to what it shares with a neighbour, and the group's
suffix array is built; windows that are equal stand next to each other in it.

The suffix array comes from linear grouping: suffixes are grouped by their first byte; groups are processed from the
largest down; each suffix's pointer to the previous smaller one moves that suffix behind the rest of its group; in the
end suffixes with equal Lyndon prefixes share a group, groups are in order, and one pass emits the order inside them.
Nothing is renamed or sorted again.

Groups of more than `GROUP` different segments aren't put into one task: their windows are counted by digest instead,
which gives the same result.

Words are what ASCII white space parts; they count as equal by a 64-bit hash, whatever white space is between them. The
white space after a removed run of words goes with it.

Defined results: a null text is empty; texts shorter than a window lose nothing; equal texts are texts of their own, so
that both lose every window; other columns are ignored by `scan` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common



class Unit(NamedTuple):
    """What a window is counted in: `window` symbols, `gram` (a power of two) of which choose its group. A symbol stands
    as `width` bytes where texts are compared."""

    window: int
    gram: int
    width: int


def by_bytes(window: int) -> Unit:
    return Unit(window, min(32, 1 << window.bit_length() - 1), 1)


def by_words(window: int) -> Unit:
    return Unit(window, min(8, 1 << window.bit_length() - 1), 8)


BYTES = by_bytes(400)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
#: Different segments of a group that are sorted together, 3 MB at most; more are counted by digest. Building an
#: array takes less than 200 bytes of a worker's memory for each byte of text.
GROUP = 4000
_R = np.random.default_rng(97)
_BYTE = _R.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _R.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
#: Positions at a time, so that a position fits the low bits of a key.
_SPAN = 1 << 20
_LOW = np.uint64(_SPAN - 1)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def symbols(data: bytes, unit: Unit) -> tuple[np.ndarray, bytes]:
    """A text's symbols as random 64-bit numbers, and as bytes to compare."""
    if unit.width == 1:
        return _BYTE[np.frombuffer(data, np.uint8)], data
    words = data.split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return h, h.tobytes()


def suffix_order(x: Sequence[int], alphabet: int = 256) -> list[int]:
    """The suffix array of x, whose symbols are below `alphabet`."""
    n = len(x)
    if not n:
        return []
    # groups: members in ascending order, some of which may have moved on; `after` and `before` keep their order
    members: list[list[int]] = [[] for _ in range(alphabet)]
    for i, b in enumerate(x):
        members[b].append(i)
    group = list(x)
    before, after, last = [-1] * alphabet, [-1] * alphabet, -1
    first = -1
    for b in range(alphabet):
        if members[b]:
            before[b] = last
            if last >= 0:
                after[last] = b
            else:
                first = b
            last = b
    size = [0] * alphabet
    done = bytearray(n)
    smaller = [-1] * n  # the previous suffix in a smaller group; known once a group is done
    g = last
    while g >= 0:
        now = [i for i in members[g] if group[i] == g]
        moved: dict[tuple[int, int], list[int]] = {}
        root = times = -1
        for i in now:
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            if j >= 0 and group[j] == g:
                j = smaller[j]  # one of this group stands before it: they share their pointer
            smaller[i] = j
            if j != root:
                if root >= 0:
                    key = (group[root], times)
                    if key in moved:
                        moved[key].append(root)
                    else:
                        moved[key] = [root]
                root, times = j, 1
            else:
                times += 1
        if root >= 0:
            moved.setdefault((group[root], times), []).append(root)
        # the more often the current context follows, the larger is the new group
        for (h, _), some in sorted(moved.items(), key=lambda m: -m[0][1]) if len(moved) > 1 else moved.items():
            new = len(members)
            members.append(some)
            size.append(0)
            nxt = after[h]
            before.append(h)
            after.append(nxt)
            after[h] = new
            if nxt >= 0:
                before[nxt] = new
            for p in some:
                group[p] = new
        for i in now:
            done[i] = 1
        size[g] = len(now)
        members[g] = now
        g = before[g]
    start, at, g = [0] * len(members), 0, first
    while g >= 0:
        start[g] = at
        at += size[g]
        g = after[g]
    out = [0] * n
    j = n - 1
    k = -1
    while True:
        while j >= 0 and done[j]:
            done[j] = 0
            g = group[j]
            s = start[g]
            out[s] = j
            start[g] = s + 1
            j = smaller[j]
        k += 1
        if k == n:
            return out
        j = out[k] - 1


def _grams(h: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` symbols from every position, by doubling."""
    width, i = 1, 0
    while width < gram:
        h = h[:-width] * _ODD[i] + h[width:]
        h ^= h >> np.uint64(29)
        width, i = 2 * width, i + 1
    return h * _ODD[7]


def segments(hashes: np.ndarray, unit: Unit = BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one smallest gram: (its hash, first window, number of windows, its place from the first)."""
    m = unit.window - unit.gram + 1
    for base in range(0, len(hashes) - unit.window + 1, _SPAN // 2):
        part = hashes[base : base + _SPAN // 2 + unit.window - 1]
        n = len(part) - unit.window + 1
        h = _grams(part, unit.gram)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        blocks = np.concatenate([key, np.full(-len(key) % m, ~np.uint64(0))]).reshape(-1, m)
        left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        q = (np.minimum(right[:n], left[m - 1 : m - 1 + n]) & _LOW).astype(np.int64)
        a = np.flatnonzero(np.diff(q, prepend=-1))
        yield h[q[a]].view(np.int64), a + base, np.diff(a, append=n), q[a] - a


def _shared(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(x), len(y))
    if x[:hi] == y[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def repeated_windows(strings: list[bytes], weights: list[int], unit: Unit = BYTES) -> list[np.ndarray]:
    """For each string the starts of its windows that occur twice or more, counting each string by its weight."""
    wide, span = unit.width, unit.width * unit.window
    text = bytes(wide).join(strings)
    if wide == 1:
        order = suffix_order(text)
    else:
        different, numbers = np.unique(np.frombuffer(text, np.uint64), return_inverse=True)
        order = suffix_order(numbers.tolist(), len(different))
    starts = np.cumsum([0, *(len(s) // wide + 1 for s in strings)])
    who = np.repeat(np.arange(len(strings)), np.diff(starts))[: len(order)]
    inside = np.arange(len(order)) + unit.window <= starts[1:][who] - 1
    found: list[list[int]] = [[] for _ in strings]
    owner, ok = who.tolist(), inside.tolist()
    run: list[int] = []
    before = b""

    def close():
        if len(run) > 1 or run and weights[owner[run[0]]] > 1:
            for p in run:
                found[owner[p]].append(p)

    for p in order:
        if ok[p]:
            window = text[p * wide : p * wide + span]
            if window == before:
                run.append(p)
            else:
                close()
                run, before = [p], window
    close()
    return [np.sort(np.array(f, np.int64)) - s for f, s in zip(found, starts)]


def resolve(group: list[tuple[int, int, int, bytes]], unit: Unit = BYTES) -> list[tuple[int, list[list[int]]]]:
    """Of the different segments of one gram (name, copies, place of the gram, symbols): the ranges to remove."""
    n, wide = len(group), unit.width
    reach = []
    for side in ([s[q * wide :] for _, _, q, s in group], [s[: q * wide][::-1] for _, _, q, s in group]):
        far = [0] * n
        order = sorted(range(n), key=side.__getitem__)
        for a, b in zip(order, order[1:]):
            k = _shared(side[a], side[b]) // wide
            far[a], far[b] = max(far[a], k), max(far[b], k)
        reach.append(far)
    out, cut, weight = [], {}, {}
    for i, (name, copies, q, s) in enumerate(group):
        right, left = reach[0][i], reach[1][i]
        if copies > 1:
            out.append((name, [[0, len(s) // wide]]))
        if right + left >= unit.window:  # else no window of it is in another segment
            t = s[(q - left) * wide : (q + right) * wide]
            cut.setdefault(t, []).append((name, copies, q - left))
            weight[t] = weight.get(t, 0) + copies
    open_ = [t for t in cut if any(c == 1 for _, c, _ in cut[t])]
    strings = list(cut)
    if open_ and len(cut) > 1:
        starts = repeated_windows(strings, [weight[t] for t in strings], unit)
    else:
        starts = [np.arange(len(t) // wide - unit.window + 1) if weight[t] > 1 else np.zeros(0, np.int64) for t in strings]
    for t, at in zip(strings, starts):
        if len(at):
            ranges = _ranges(at, at + unit.window)
            out += [(name, [[a + shift, b + shift] for a, b in ranges]) for name, copies, shift in cut[t] if copies == 1]
    return out


def _ranges(begin: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Maximal runs of the union of [begin, end), from rising begins."""
    top = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > top[:-1]]))
    return [[int(begin[a]), int(top[b - 1])] for a, b in zip(new, [*new[1:], len(begin)])]


def _text_id(text) -> F.Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _segment_rows(docs: DataFrame, text: str, unit: Unit) -> DataFrame:
    """tid, gram, name (hash of the segment's symbols), a, windows, place for each segment of each row."""
    wide = unit.width
    fields = [("tid", pa.binary()), ("gram", pa.int64()), ("name", pa.int64()), ("a", pa.int64()), ("windows", pa.int32()), ("place", pa.int32())]

    def run(batches):
        common.only("suffix_dedup")
        for b in batches:
            got: list[list] = [[] for _ in fields]
            held = 0
            for tid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes, data = symbols(encoded(t), unit)
                for gram, a, n, place in segments(hashes, unit):
                    names = [xxhash.xxh3_64_intdigest(data[i * wide : (i + k + unit.window - 1) * wide]) for i, k in zip(a.tolist(), n.tolist())]
                    for c, v in zip(got, ([tid] * len(a), gram, np.array(names, np.uint64).view(np.int64), a, n, place)):
                        c.append(v)
                    held += len(a)
                if held > 50_000:
                    yield _batch(got, fields)
                    got, held = [[] for _ in fields], 0
            if held:
                yield _batch(got, fields)

    return docs.select(_text_id(F.col(text)).alias("tid"), text).mapInArrow(run, "tid binary, gram long, name long, a long, windows int, place int")


def _batch(got: list[list], fields) -> pa.RecordBatch:
    columns = [pa.array([y for x in got[0] for y in x], pa.binary()), *(pa.array(np.concatenate(c), t) for c, (_, t) in zip(got[1:], fields[1:]))]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])


RESOLVED = "gram long, name long, ranges array<array<int>>"


def _sorted_groups(rows: DataFrame, unit: Unit) -> DataFrame:
    """Groups of segments, resolved by their suffix arrays. Rows are dealt and sorted by gram; a group is at most GROUP
    segments, and one group is held at a time."""

    def run(batches):
        common.only("suffix_dedup")
        gram, group, done = None, {}, []

        def out():
            part = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.list_(pa.list_(pa.int32())))], ["gram", "name", "ranges"])
            done.clear()
            return part

        for b in batches:
            for g, *row in zip(*(c.to_pylist() for c in b.columns)):
                if g != gram:
                    done += [(gram, name, r) for name, r in resolve(list(group.values()), unit)] if group else []
                    gram, group = g, {}
                    if len(done) > 5000:
                        yield out()
                group[row[0]] = tuple(row)
        if group:
            done += [(gram, name, r) for name, r in resolve(list(group.values()), unit)]
        yield out()

    return rows.select("gram", "name", "copies", "place", "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(run, RESOLVED)


def _counted_groups(rows: DataFrame, unit: Unit) -> DataFrame:
    """The same for groups of any size: every window by its digest, counted in partial sums."""

    def run(batches):
        common.only("suffix_dedup")
        for b in batches:
            for gram, name, copies, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                wide, span = unit.width, unit.width * unit.window
                w = [xxhash.xxh3_128_digest(s[i : i + span]) for i in range(0, len(s) - span + 1, wide)]
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array([gram] * n, pa.int64()), pa.array([name] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array(w, pa.binary()), pa.array(range(n), pa.int32())], ["gram", "name", "copies", "digest", "at"])

    windows = rows.select("gram", "name", "copies", "bytes").mapInArrow(run, "gram long, name long, copies long, digest binary, at int")
    often = windows.groupBy("digest").agg(F.sum("copies").alias("c")).filter("c > 1").select("digest")
    return windows.join(often, "digest").groupBy("gram", "name").agg(F.sort_array(F.collect_list(F.array(F.col("at"), F.col("at") + unit.window))).alias("ranges"))


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: Unit = BYTES) -> DataFrame:
    """tid (digest of a text), ranges (begin, end in symbols; they may overlap) for every text that loses some."""
    spark = common.ship(docs.sparkSession)
    store = common.Store(spark, "suffixes")
    # One row for each segment of each different text; copies of a text count.
    parts = store(_segment_rows(docs, text, unit).groupBy("gram", "name", "tid", "a", "windows", "place").agg(F.count(F.lit(1)).alias("m")), "segments")
    same = parts.groupBy("gram", "name").agg(F.sum("m").alias("copies"), F.min(F.struct("tid", "a", "windows", "place")).alias("one"))
    same = store(same, "different")
    groups = same.groupBy("gram").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("different")).filter("total > 1")
    marked = store(same.join(groups, "gram").drop("total"), "marked")
    whole = marked.filter("different = 1").select("gram", "name", F.expr(f"array(array(0, one.windows + {unit.window - 1}))").alias("ranges"))

    # Fetch one copy of each segment that has to be sorted. A text is read from the row with its smallest id.
    wanted = marked.filter("different > 1").select("one.tid", F.struct("gram", "name", "copies", "one.a", "one.windows", "one.place", "different").alias("s")).groupBy("tid").agg(F.collect_list("s").alias("s"))
    keyed = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), _text_id(F.col(text)).alias("tid"))
    home = keyed.groupBy("tid").agg(F.min("k").alias("home"))
    wanted = store(wanted.join(home, "tid"), "wanted")

    def fetch(batches):
        kinds, names = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), ["gram", "name", "copies", "place", "bytes", "different"]
        rows: list[tuple] = []

        def part():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for b in batches:
            for t, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, wide = symbols(encoded(t), unit)[1], unit.width
                rows += [(s["gram"], s["name"], s["copies"], s["place"], data[s["a"] * wide : (s["a"] + s["windows"] + unit.window - 1) * wide], s["different"]) for s in some]
                if len(rows) >= 2000:
                    yield part()
        if rows:
            yield part()

    found = keyed.join(wanted.withColumnRenamed("tid", "w").hint("merge"), (F.col("tid") == F.col("w")) & F.col("k").eqNullSafe(F.col("home"))).select("t", "s")
    fetched = store(found.mapInArrow(fetch, "gram long, name long, copies long, place int, bytes binary, different long"), "fetched")
    sorted_ = _sorted_groups(fetched.filter(f"different <= {GROUP}"), unit)
    counted = _counted_groups(fetched.filter(f"different > {GROUP}").dropDuplicates(["gram", "name"]), unit)
    ranges = store(whole.unionByName(sorted_).unionByName(counted), "ranges")
    store.drop("different", "marked", "wanted", "fetched")
    every = parts.join(ranges, ["gram", "name"]).select("tid", F.expr("transform(ranges, r -> array(a + r[0], a + r[1]))").alias("r"))
    by_text = store(every.groupBy("tid").agg(F.flatten(F.collect_list("r")).alias("ranges")), "by_text")
    store.drop("segments", "ranges")
    return by_text


def united(ranges, data: bytes, unit: Unit = BYTES) -> list[list[int]]:
    """Maximal runs of bytes of a text, from ranges of its symbols."""
    if not ranges:
        return []
    x = np.array(ranges, np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    runs = _ranges(x[:, 0], x[:, 1])
    if unit.width == 1:
        return runs
    at = [m.span() for m in _WORD.finditer(data)]
    return [[at[a][0], at[b - 1][1]] for a, b in runs]


def kept_bytes(data: bytes, spans: list[list[int]]) -> bytes:
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:a])
        last = b
    return b"".join([*out, data[last:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: Unit = BYTES) -> DataFrame:
    """key, n_bytes, n_removed, spans (maximal removed runs of bytes, [begin, end)), kept_sha256 for every row."""

    def run(batches):
        common.only("suffix_dedup")
        for b in batches:
            rows = []
            for t, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = encoded(t)
                spans = united(ranges, data, unit)
                rows.append((len(data), sum(e - s for s, e in spans), spans, hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds))], [key, "n_bytes", "n_removed", "spans", "kept_sha256"])

    both = docs.select(key, text, _text_id(F.col(text)).alias("tid")).join(repeated_ranges(docs, key, text, unit), "tid", "left").select(key, text, "ranges")
    return both.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: Unit = BYTES) -> DataFrame:
    """All rows and columns, each text without its repeated passages; of a character cut in two nothing is left."""

    def run(batches):
        common.only("suffix_dedup")
        for b in batches:
            i = b.schema.get_field_index(text)
            texts = []
            for t, ranges in zip(b.column(i).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                data = encoded(t) if ranges else b""
                texts.append(kept_bytes(data, united(ranges, data, unit)).decode("utf-8", "ignore") if ranges else t)
            columns = [pa.array(texts, pa.string()) if j == i else b.column(j) for j in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    ranges = repeated_ranges(docs, key, text, unit).select(F.col("tid").alias("tid_of_repeats"), F.col("ranges").alias("ranges_of_repeats"))
    both = docs.join(ranges, _text_id(F.col(text)) == F.col("tid_of_repeats"), "left").select(*docs.columns, "ranges_of_repeats")
    return both.mapInArrow(run, docs.schema)
