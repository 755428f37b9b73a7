"""Phrase collocation mining by pivot partitioning.

A phrase belongs to the rarest of its words, its pivot. Around every occurrence of a word, the words that a phrase of
that pivot can reach are a fragment: up to `longest - 1` words to each side, ended by a border of a piece, by a word that
can't be frequent, and by any word that is rarer than the pivot. (To the left it also ends at the pivot itself, so that
a phrase in which the pivot occurs twice is counted from the first.) Equal fragments are counted where they arise and
routed to their pivot; there all phrases that hold the pivot's place are counted, and only the frequent ones leave. Pivots with
few occurrences share a group.

How rare a word is comes from a table of fixed size: counts of words added up in `SLOTS` slots by hash. A slot's count is
never below a word's, so that nothing frequent is lost, and any fixed order of words gives the same result; only how
evenly the work is dealt out depends on it. Pivots with more than `SHARE` occurrences go to several groups by a hash of
the fragment, and what these count is added up afterwards.

A candidate's parts occur at least as often as it does, so that they are among the frequent phrases too. A candidate
that lies inside a longer one with the same count lies inside one that is a word longer with the same count, so that one
equal join finds it.

Defined results: a null text has no words, a null language is `und`; an empty table gives no rows; repeated rows, and
rows without an id, count as often as they occur; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Slots of the table of counts, whatever the input (8 MB).
SLOTS = 1 << 20
#: Occurrences of a pivot that one group takes.
SHARE = 1 << 17
#: Bytes of a group's lines that are counted at once.
MOST = 1 << 26
#: Entries that a task counts before it hands them on, and words that a worker looks up at once.
ENTRIES, WINDOW = 300_000, 200_000
#: Bytes of a text that are split at once, if there is white space or a border to split at.
SLICE = 1 << 20
_BORDER = b"\xff"  # no byte of UTF-8
_TABLE = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z), with a border before each piece; long texts in several lists."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE)
    at, start = 0, [_BORDER]
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            end = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            if end <= at:  # a word longer than a slice
                ends = [x for x in (raw.find(b" ", at + 1), raw.find(b"\n", at + 1)) if x > 0]
                end = min(ends, default=len(raw))
        part = raw[at:end].replace(b"\n", b" \xff ")
        # only spaces are left to split at
        yield start + part.split()
        at, start = end, []


def _by_lang(b: pa.RecordBatch) -> Iterator[tuple[str, list[str | None]]]:
    texts: dict[str, list[str | None]] = {}
    for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        texts.setdefault("und" if lang is None else lang, []).append(text)
    yield from texts.items()


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, n) over all texts."""

    def rows(counts: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1].decode() for k in counts], pa.string()), pa.array(counts.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("collocations")
        counts: dict[str, Counter[bytes]] = {}
        for b in batches:
            for lang_, texts in _by_lang(b):
                here = counts.setdefault(lang_, Counter())
                for t in texts:
                    for part in tokens(t):
                        here.update(part)
                    if len(here) > ENTRIES:
                        here.pop(_BORDER, None)
                        yield rows({(lang_, w): n for w, n in here.items()})
                        here.clear()
            if sum(map(len, counts.values())) > 2 * ENTRIES:
                yield from (rows({(x, w): n for w, n in here.items() if w != _BORDER}) for x, here in counts.items())
                counts.clear()
        yield from (rows({(x, w): n for w, n in here.items() if w != _BORDER}) for x, here in counts.items())

    common.ship(docs.sparkSession)
    parts = docs.select(lang, text).mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def slot_counts(words: DataFrame, least: int) -> np.ndarray:
    """Counts by slot, 0 where no word of the slot can be frequent: at most `SLOTS` rows come to the driver."""
    slot = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word").cast("binary"))) % SLOTS
    got = words.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return table


class Rarity(dict):
    """A word's place in the order of pivots, for one language: the slot's count, then the hash; -1 if it can't be
    frequent. Found when a word is first asked for."""

    def __init__(self, lang: str, table: np.ndarray) -> None:
        super().__init__({_BORDER: -1})
        self.base, self.table = zlib.crc32(lang.encode() + b"\0"), table

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word, self.base)
        n = min(int(self.table[h % len(self.table)]), (1 << 30) - 1)
        got = self[word] = n << 32 | h if n else -1
        return got


def reach(rarity: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and right of each place its fragment takes; -1 for places without a fragment."""
    n, side = len(rarity), longest - 1
    padded = np.concatenate([np.full(side, -1, np.int64), rarity, np.full(side, -1, np.int64)])
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    on = rarity >= 0
    for k in range(1, side + 1):
        on = on & (padded[side - k : side - k + n] > rarity)
        left += on
    on = rarity >= 0
    for k in range(1, side + 1):
        on = on & (padded[side + k : side + k + n] >= rarity)
        right += on
    left[(rarity < 0) | (left + right == 0)] = -1
    return left, right


def windows(texts: list[str | None], side: int, size: int) -> Iterator[tuple[list[bytes], int, int]]:
    """Lists of about `size` words and borders with the range of places to look at; what stands around it is there to be reached."""
    held: list[bytes] = []
    start = 0
    for t in texts:
        for part in tokens(t):
            held += part
            if len(held) >= size:
                end = len(held) - side
                yield held, start, end
                held, start = held[max(0, end - side) :], min(side, end)
    yield held, start, len(held)


def fragments(docs: DataFrame, table: np.ndarray, longest: int = 5, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, pivot, part, lines): fragments and how often they occur. A pivot with more than `SHARE` occurrences is named
    by its hash and has several parts, by a hash of the fragment; the others share groups of about as many occurrences,
    which have negative numbers and one part, 0. A line is the pivot's place in a fragment, its words, and a count; a task
    gives the lines of a group together, so that rows are few."""
    sent = common.ship(docs.sparkSession).sparkContext.broadcast(table)  # SLOTS numbers
    places = [b"%d" % k for k in range(longest)]
    shared = 1 + int(table.sum()) // SHARE

    def rows(lang_: str, counts: dict[int, dict[bytes, int]]) -> pa.RecordBatch:
        groups: dict[tuple[int, int], list[bytes]] = defaultdict(list)
        for r, some in counts.items():
            parts, h = 1 + (r >> 32) // SHARE, r & 0xFFFFFFFF
            if parts == 1:
                groups[-1 - h % shared, 0] += [b"%s %d" % x for x in some.items()]
            else:
                for raw, n in some.items():
                    groups[h, 1 + zlib.crc32(raw) % parts].append(b"%s %d" % (raw, n))
        pivots = list(groups)
        columns = [pa.array([lang_] * len(groups), pa.string()), pa.array([g[0] for g in pivots], pa.int64()), pa.array([g[1] for g in pivots], pa.int32()), pa.array(map(b"\n".join, groups.values()), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "pivot", "part", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("collocations")
        rarities: dict[str, Rarity] = {}
        counts: dict[str, dict[int, dict[bytes, int]]] = {}
        size = 0
        for b in batches:
            for lang_, texts in _by_lang(b):
                here = counts.setdefault(lang_, defaultdict(dict))
                for held, start, end in windows(texts, longest - 1, WINDOW):
                    known = rarities.get(lang_)
                    if known is None or len(known) > ENTRIES:
                        known = rarities[lang_] = Rarity(lang_, sent.value)
                    rarity = np.fromiter(map(known.__getitem__, held), np.int64, len(held))
                    left, right = reach(rarity, longest)
                    at = start + np.flatnonzero(left[start:end] >= 0)
                    x = left[at]
                    for r, i, j, k in zip(rarity[at].tolist(), (at - x).tolist(), (at + right[at] + 1).tolist(), x.tolist()):
                        raw = b" ".join([places[k], *held[i:j]])
                        some = here[r]
                        some[raw] = some.get(raw, 0) + 1
                    size += len(at)
                    if size > 4 * ENTRIES:  # occurrences; entries are fewer
                        yield from (rows(x, some) for x, some in counts.items() if some)
                        for some in counts.values():
                            some.clear()
                        size = 0
        yield from (rows(x, some) for x, some in counts.items() if some)

    return docs.select(lang, text).mapInArrow(run, "lang string, pivot long, part int, lines binary")


def mine(routed: DataFrame, least: int, longest: int = 5) -> DataFrame:
    """(lang, phrase, n) of the phrases of two words or more that their pivots own, from fragments routed to their pivot:
    counts of at least `least` from groups that hold all of their pivots; partial counts from the others."""
    groups = routed.repartition("lang", "pivot", "part").sortWithinPartitions("lang", "pivot", "part")

    def batch(found: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
        columns = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(next(columns), pa.string()), pa.array(next(columns), pa.binary()).cast(pa.string()), pa.array(next(columns), pa.int64())], ["lang", "phrase", "n"])

    def count(group: list[bytes], whole: bool) -> dict[bytes, int]:
        """Phrases of a group. What lies beyond a neighbour counts only if the pair of pivot and neighbour is frequent,
        which is known where the group holds all of its pivots' fragments."""
        pairs: dict[bytes, int] = {}
        if whole:
            for lines in group:
                for line in lines.split(b"\n"):
                    left, *w, n = line.split(b" ")
                    at, n = int(left), int(n)
                    if at:
                        pair = b" ".join(w[at - 1 : at + 1])
                        pairs[pair] = pairs.get(pair, 0) + n
                    if at + 1 < len(w):
                        pair = b" ".join(w[at : at + 2])
                        pairs[pair] = pairs.get(pair, 0) + n
            pairs = {x: n for x, n in pairs.items() if n >= least}
            if not pairs:
                return {}
        counts: dict[bytes, int] = {}
        for lines in group:
            for line in lines.split(b"\n"):
                left, *w, n = line.split(b" ")
                at, size, n = int(left), len(w), int(n)
                first, end = max(0, at - longest + 1), size
                if whole:
                    if at and b" ".join(w[at - 1 : at + 1]) not in pairs:
                        first = at
                    if at + 1 < size and b" ".join(w[at : at + 2]) not in pairs:
                        end = at + 1
                for i in range(first, at + 1):
                    for j in range(max(at + 1, i + 2), min(end, i + longest) + 1):
                        phrase = b" ".join(w[i:j])
                        counts[phrase] = counts.get(phrase, 0) + n
        return counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("collocations")
        key, group, size, whole = None, [], 0, True
        found: list[tuple[str, bytes, int]] = []

        def close() -> None:
            found.extend((key[0], p, n) for p, n in count(group, whole).items() if n >= least or not whole)

        for b in batches:
            for *new, lines in zip(*(c.to_pylist() for c in b.columns)):
                # a group has a pivot's share at most, unless hashes of pivots are equal: then it is counted in parts
                if new != key or size > MOST:
                    if group:
                        whole = whole and new != key
                        close()
                    whole = new[2] == 0 if new != key else False
                    key, group, size = new, [], 0
                group.append(lines)
                size += len(lines)
                if len(found) > 10_000:
                    yield batch(found)
                    found.clear()
        if group:
            close()
        if found:
            yield batch(found)

    return groups.mapInArrow(run, "lang string, phrase string, n long")


def frequent(docs: DataFrame, store: common.Store, least: int = 100, longest: int = 5, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words that occur at least `least` times as (lang, phrase, k, a), and (lang, n): words."""
    words = store(word_counts(docs, lang, text), "words")
    table = slot_counts(words, least)
    found = mine(fragments(docs, table, longest, lang, text), least, longest).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    single = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))
    every = single.unionByName(found.filter(F.col("a") >= least)).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "a")
    phrases = store(every, "phrases")
    sizes = store(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    store.drop("words")
    return phrases, sizes


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates, by the cut with the lowest score."""
    w = F.split("phrase", " ")
    cuts = phrases.filter(F.col("k") >= 2).select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(w, F.lit(1), F.col("cut")).alias("first"), _joined(w, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    known = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(sizes, "lang")

    def wide(x: str) -> str:
        return f"cast({x} as decimal(17, 0))"  # products of two and three have at most 38 digits

    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    cuts = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "cut", "l", "r").alias("c"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c"))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def maximal(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """The candidates without those that lie inside a longer one with the same count."""
    w = F.split("phrase", " ")
    longer = phrases.filter(F.col("k") >= 3).select("lang", "a", F.explode(F.array(_joined(w, F.lit(1), F.col("k") - 1), _joined(w, F.lit(2), F.col("k") - 1))).alias("phrase"))
    return candidates.join(longer, ["lang", "phrase", "a"], "left_anti")


def top(candidates: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of each language with their rank: first of each of 64 parts, so that no task gets a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = candidates.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= limit)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, limit: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `limit` collocations of each language."""
    store = common.Store(common.ship(docs.sparkSession), "collocations")
    phrases, sizes = frequent(docs, store, least, longest, lang, text)
    return top(maximal(scored(phrases, sizes), phrases), limit)
