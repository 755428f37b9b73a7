"""Best-fit packing by sums of squares.

Texts become token ids and one end mark; what is longer than a sequence is cut into pieces. A piece goes where the sum,
over all residual gaps, of the squared number of open sequences with that gap becomes smallest: into an open sequence of
some gap, or into a new one. Sequences that come out full, or unopened, don't count. Pieces are placed from long to
short, so that the short ones close what the long ones left.

Placing is for one list in one order, so pieces are dealt out at random to groups of at most `GROUP`, each of which is
packed by itself in one task. What a group leaves in sequences that aren't full is packed again, together with what
other groups left, as long as there is more than one group; sequences that are full are never touched again. A group's
remainder is a few hundred sequences, so that rounds shrink fast. Nothing passes through the driver but counts.

Defined results: a null or empty text is one piece with the end mark only; the last piece of a cut text may be shorter;
null ids and repeated rows are documents of their own; sequence ids are numbers without other meaning; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import contextlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

#: Pieces that a task packs together, some MB of numbers.
GROUP = 1 << 16
#: Words and chunks of text that a worker remembers in each of two generations, and the longest that are remembered.
MEMORY, LONGEST = 400_000, 60
#: Numbers of ids that a worker remembers for the words of Latin-1 texts.
MOST_IDS = 8_000_000
_UNIT = re.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(r"[^\p{White_Space}]+")
# Latin-1, by which letters can be told apart and lower-cased byte by byte; it is its own normal form
_SPACE, _NUMBER, _LETTER, _MARK = range(4)
_SMALL = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)
_KIND = np.array([_SPACE if _UNIT.match(c) is None and c.isspace() else {"N": _NUMBER, "L": _LETTER}.get(unicodedata.category(c)[0], _MARK) for c in map(chr, range(256))], np.uint8)
_WORD = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, for tokenizers that lower-case, drop white space, and
    merge within words only, as the one here does.

    Latin-1 texts are cut into words many at a time, and only the different words are looked up. In others every chunk
    between white space is looked up, and a new one is cut into words. New words are encoded by the library's model, many in
    one call. What holds the text of a special token goes through the whole library by itself."""

    def __init__(self, spec: bytes) -> None:
        plain = json.loads(spec)
        model = plain["model"]
        split, byte_level = plain["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in plain["normalizer"]["normalizers"]], split["type"], byte_level["type"], model.get("end_of_word_suffix")
        if kinds != (["NFC", "Replace", "Lowercase"], "Split", "ByteLevel", "</w>"):
            raise ValueError("only tokenizers of words with an end mark are read here")
        self.library = Tokenizer.from_buffer(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [x["content"] for x in plain["added_tokens"]]
        # the model alone: words arrive in the byte-level alphabet, parted by spaces
        self.model = Tokenizer.from_str(json.dumps(plain | {"normalizer": None, "post_processor": None, "truncation": None, "padding": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        free = iter(range(256, 512))
        self.letters = {b: b if b in shown else next(free) for b in range(256)} | {10: 10}
        self.word = regex.compile(split["pattern"]["Regex"])
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}  # ids of chunks, words among them: the newer generation
        self.old: dict[str, bytes] = {}
        self.latin = split["pattern"]["Regex"] == _WORD
        self.number: dict[bytes, int] = {}  # of words of Latin-1 texts
        self.flat, self.begin, self.size, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # their ids, where each word's begin, how many, and in how many batches

    @staticmethod
    def split(text: str | None) -> list[str]:
        """The chunks of a text, in small letters."""
        if not text:
            return []
        if not text.isascii():
            # letters are lower-cased one by one, so a sigma that ends a word is the usual one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return _CHUNK.findall(text) if _UNIT.search(text) else text.split()

    def learn(self, chunks: list[str]) -> None:
        """The ids of new chunks, as little-endian bytes, and of the words that they are made of."""
        known, old, whole = self.known, self.old, self.word.findall
        words: set[str] = set()
        made: list[tuple[str, list[str]]] = []
        for c in chunks:
            core = c.rstrip(".,;:!?")
            if core.isalpha() and (core.isascii() or max(core) < "ɐ"):  # the usual cases, without the pattern
                if core is c:
                    words.add(c)
                    continue
                parts = [core, c[len(core) :]]
            else:
                parts = whole(c)
            words.update(parts)
            made.append((c, parts))
        new = []
        for w in words - known.keys():
            if (ids := old.get(w)) is None:
                new.append(w)
            else:
                known[w] = ids
        if new:
            ids, ends = self.model_ids("\n".join(new))
            ends = (ends * 4).tolist()
            raw = ids.tobytes()
            known.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        for c, parts in made:
            known[c] = b"".join([known[w] for w in parts])

    def model_ids(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one in a line, and the end of each word's. A line end isn't in the alphabet and no word has one."""
        shown = lines.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.flatnonzero(self.last[ids]) + 1

    def taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one word after the other, and the end of each word's."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[numbers] - ends + size, size)
        at += np.arange(len(at))
        return self.flat[at], ends

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of different words; new ones are learnt. When there are too many, those of a single batch are forgotten."""
        if len(self.number) >= MEMORY * 2 or len(self.flat) >= MOST_IDS:
            again = [w for w, n in self.number.items() if self.used[n] > 1 and len(w) <= LONGEST]
            kept = np.array([self.number[w] for w in (again if len(again) < MEMORY else [])], np.int64)
            flat, ends = self.taken(kept)
            self.number = dict(zip(again, range(len(kept))))
            self.flat, self.size = flat, self.size[kept]
            self.begin, self.used = ends - self.size, np.zeros(len(kept), np.int64)
        number = self.number
        new = [w for w in words if w not in number]
        if new:
            ids, ends = self.model_ids(b"\n".join(new).decode("latin-1"))
            begins = np.concatenate([[0], ends[:-1]])
            number.update(zip(new, range(len(number), len(number) + len(ends)), strict=True))
            self.begin, self.size = np.concatenate([self.begin, begins + len(self.flat)]), np.concatenate([self.size, ends - begins])
            self.flat, self.used = np.concatenate([self.flat, ids]), np.concatenate([self.used, np.zeros(len(new), np.int64)])
        got = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.used[got] += 1
        return got

    def encode_latin(self, texts: list[bytes]) -> Iterator[bytes]:
        """The same as `encode` for Latin-1 texts without special tokens."""
        whole = np.frombuffer(b"\n".join([*texts, b"\n\n"]), np.uint8)
        kind, small = _KIND[whole], _SMALL[whole]
        begins = kind == _NUMBER
        begins[0] = True
        begins[1:] |= kind[1:] != kind[:-1]
        # 's, 't, 'm, 'd, 're, 've and 'll are words, wherever an apostrophe begins one
        at = np.flatnonzero(begins & (whole == ord("'")))
        a, b = small[at + 1], small[at + 2]
        n = np.isin(a, list(b"stmd")) + 2 * (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        at, n = at[n > 0], n[n > 0]
        begins[at + 1] = False
        begins[at + 1 + n] = True
        full = kind != _SPACE
        letters = small[full]
        offsets = np.append(np.flatnonzero(begins[full]), len(letters)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        ids, ends = self.taken(self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()])
        before = np.searchsorted(np.flatnonzero(begins & full), np.cumsum([0, *(len(t) + 1 for t in texts)]))
        cuts = (np.concatenate([[0], ends])[before] * 4).tolist()
        raw = ids.tobytes()
        for i, j in zip(cuts, cuts[1:]):
            yield raw[i:j]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of every text, as little-endian 32-bit numbers."""
        latin: dict[int, bytes] = {}
        for i, t in enumerate(texts if self.latin else []):
            if not (t and any(x in t for x in self.specials)):
                with contextlib.suppress(UnicodeEncodeError):
                    latin[i] = (t or "").encode("latin-1")
        some = self.encode_latin(list(latin.values()))
        others = self.encode_chunks([t for i, t in enumerate(texts) if i not in latin])
        for i in range(len(texts)):
            yield next(some if i in latin else others)
        next(others, None)  # it forgets long chunks at its end

    def encode_chunks(self, texts: list[str | None]) -> Iterator[bytes]:
        """The same for any texts, by their chunks."""
        special = {i for i, t in enumerate(texts) if t and any(x in t for x in self.specials)}
        split = [[] if i in special else self.split(t) for i, t in enumerate(texts)]
        if len(self.known) >= MEMORY:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = []
        for c in set().union(*split) - known.keys():
            if (ids := old.get(c)) is None:
                new.append(c)
            else:
                known[c] = ids
        self.learn(new)
        ids_of = known.__getitem__
        for i, chunks in enumerate(split):
            if i in special:
                yield np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(ids_of, chunks))
        for c in [c for c in new if len(c) > LONGEST]:
            known.pop(c, None)


_LOADED: dict[int, Encoder] = {}
common.CACHES["packing"] = _LOADED.clear


def _batches(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` characters together, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if texts:
        yield start, len(texts)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document: its ids and the end mark, cut if longer than `capacity`."""
    with open(path, "rb") as f:
        spec = common.ship(docs.sparkSession).sparkContext.broadcast(f.read())  # a file of a few MB
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("packing")
        which = hash(spec.value)
        if which not in _LOADED:
            _LOADED.clear()
            _LOADED[which] = Encoder(spec.value)
        encoder, wide = _LOADED[which], capacity * 4
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            row, rows = [], []
            for i, j in _batches(texts, 1 << 22):
                for k, raw in enumerate(encoder.encode(texts[i:j]), i):
                    raw += last
                    for n, at in enumerate(range(0, len(raw), wide)):
                        part = raw[at : at + wide]
                        row.append(k)
                        rows.append((n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), *arrays], [key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length, in the order given, and the gap that each bin is left with."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by gap
    count = np.zeros(capacity + 1, np.int64)  # how many; 0 at the gaps that don't count: none, and all
    gaps: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        # the change of the sum of squares: the bin leaves gap g and comes to gap g - s
        fits = count[s:capacity]
        got = -1
        if fits.any():
            change = 2 - 2 * fits + 2 * count[: capacity - s]
            change[0] -= 1  # nothing is added where the bin comes out full
            change[fits == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if s == capacity or change[best] < 1 + 2 * count[capacity - s]:
                got = s + best
        if got < 0:
            bin_, got = len(gaps), capacity
            gaps.append(capacity)
        else:
            bin_ = by_gap[got].pop()
            count[got] -= 1
        where[i], offset[i] = bin_, capacity - got
        gaps[bin_] = got - s
        if got > s:
            by_gap[got - s].append(bin_)
            count[got - s] += 1
    return where, offset, np.array(gaps, np.int64)


def place_again(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for lengths that fall. What came into bins that aren't full is placed again by itself, as long as that
    saves bins: the counts of gaps that the full ones went through don't steer it then."""
    where, offset, gaps = place(lengths, capacity)
    at = np.flatnonzero(gaps[where] > 0)
    while len(at):
        w, o, g = place(lengths[at], capacity)
        if len(g) >= len(np.unique(where[at])):
            break
        where[at], offset[at] = w + len(gaps), o
        gaps = np.concatenate([gaps, g])
        at = at[g[w] > 0]
    return where, offset, gaps


def _pack_group(capacity: int, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
    where, offset, gaps = place_again(rows["length"].to_numpy(), capacity)
    first = offset == 0
    opened = np.zeros(len(gaps), np.int64)
    opened[where[first]] = rows["uid"].to_numpy()[first]
    # a sequence's number is that of the piece that opened it: unique, whatever the group
    return rows.assign(sequence_id=opened[where], offset=offset, open=gaps[where] > 0)


def pack(parts: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """The columns of `parts` (with `length`, at most `capacity`), sequence_id and offset."""
    spark = common.ship(parts.sparkSession)
    store = common.Store(spark, "packing")
    # numbers are drawn once and written: what is read from here on has them for good
    numbered = store(parts.withColumn("uid", F.monotonically_increasing_id()).withColumn("draw", F.xxhash64("uid", F.lit(7))), "pieces")
    left = numbered.select("uid", "draw", "length")
    n, rounds, done = left.count(), 0, None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(capacity, rows)

    while n:
        groups = -(-n // group)
        # sizes of groups differ from `group` by some of its square root
        got = left.withColumn("g", F.pmod(F.shiftright("draw", 4 * (rounds % 8)), F.lit(groups)))
        got = got.groupBy("g").applyInPandas(run, "uid long, draw long, length long, g long, sequence_id long, offset long, open boolean").drop("g")
        got = store(got, f"round-{rounds}")
        final = got if groups == 1 else got.filter(~F.col("open"))
        done = final if done is None else done.unionByName(final)
        if groups == 1:
            break
        left = got.filter("open").select("uid", "draw", "length")
        before, n, rounds = n, left.count(), rounds + 1
        if n > 0.9 * before:  # hardly anything closes: lengths that don't add up to a sequence
            done = done.unionByName(got.filter("open"))
            break
    if done is None:
        return numbered.select(*parts.columns, F.col("uid").alias("sequence_id"), F.col("uid").alias("offset"))
    return numbered.join(done.select("uid", "sequence_id", "offset"), "uid").select(*parts.columns, "sequence_id", "offset")
