"""BPE encoding and decoding for word vocabularies with an end-of-word mark.

Encoding is the backtracking method: an Aho-Corasick automaton over the vocabulary gives the longest token that begins
at a position; it may stand after the token before it only if the two are compatible, which means that undoing merges
from their border never meets a pair that would have been merged earlier. If not, the next shorter token is tried, and
if none is left the last token is given back. Positions that failed are marked, so that no position is tried twice;
time is linear in the word. The result equals applying all merges in order of rank.

Decoding looks token texts up in one buffer by an offset table.

Defined results: a null or blank text has no tokens; token strings of added tokens in a text are those tokens, as the
file says, unless `specials=False`; lone surrogates can't occur in Spark strings; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Distinct chunks of text, and distinct words, that a worker remembers in each of two generations: when the new one is
#: full it becomes the old one, and what is still in use moves back. A generation is full too when MEAN characters for
#: each have been worked on; those of more than LONGEST aren't remembered. No result depends on it.
MEMORY, MEAN, LONGEST = 200_000, 24, 300
_UNIT = re.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(r"[^\p{White_Space}]+")
_END = "</w>"


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Memory:
    """What was worked out for some texts, in two generations."""

    def __init__(self) -> None:
        self.new: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.characters = 0  # worked on since the newer generation began

    def put(self, text: str, got: tuple[int, str, str]) -> None:
        self.characters += len(text)
        if len(self.new) >= MEMORY or self.characters >= MEMORY * MEAN:
            self.new, self.old, self.characters = {}, self.new, len(text)
        if len(text) <= LONGEST:
            self.new[text] = got


class Vocabulary:
    """A vocabulary and its merges, as a tokenizer file has them."""

    def __init__(self, spec: dict, specials: bool = True) -> None:
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("only plain BPE with the suffix </w> is read here")
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        last = {c: chr(0xE000 + b) for b, c in enumerate(self.letters)}  # a letter that ends its word, as one symbol
        self.last = last
        vocab, self.added = model["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1

        # Decoding: all token texts in one buffer, token i from offset i to offset i + 1.
        names = [""] * size
        for t, i in [*vocab.items(), *self.added.items()]:
            names[i] = t
        encoded = [x.encode("utf-8") for x in names]
        self.offsets = [0, *np.cumsum([len(x) for x in encoded]).tolist()]
        self.buffer = b"".join(encoded)

        def symbols(t: str) -> str:
            return t[: -len(_END) - 1] + last[t[-len(_END) - 1]] if t.endswith(_END) and len(t) > len(_END) else t

        # Tokens get the rank of the merge that makes them; single symbols come before all merges.
        parts = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        made = {a + b for a, b in parts}
        base = [t for t in vocab if t not in made]
        rank = {t: k for k, t in enumerate(base)} | {a + b: len(base) + k for k, (a, b) in enumerate(parts)}
        if len(rank) != len(base) + len(parts):
            raise ValueError("two merges make the same token")
        self.ids = np.array([vocab[t] for t in rank], np.int64).tolist()
        self.merge = {(rank[a], rank[b]): rank[a + b] for a, b in parts}
        self.left, self.right = list(range(len(rank))), list(range(len(rank)))
        for a, b in parts:
            self.left[rank[a + b]], self.right[rank[a + b]] = rank[a], rank[b]
        # A token that its own merges don't reach can't come out of them, and isn't matched.
        reached = [True] * len(base) + [False] * len(parts)
        self.automaton = ahocorasick.Automaton()
        for t in base:
            if len(symbols(t)) == 1:
                self.automaton.add_word(symbols(t), rank[t])
        for k, (a, b) in enumerate(parts, len(base)):
            reached[k] = reached[rank[a]] and reached[rank[b]] and self.fits(rank[a], rank[b], k)
            if reached[k]:
                self.automaton.add_word(symbols(a + b), k)
        self.automaton.make_automaton()
        self.length = [len(symbols(t)) for t in rank]
        self.shorter: list[int] = [-1] * len(rank)  # the longest token that is a proper prefix
        for t, k in rank.items():
            s = symbols(t)
            for n in range(len(s) - 1, 0, -1):
                if (x := self.automaton.get(s[:n], -1)) >= 0:
                    self.shorter[k] = x
                    break
        self.pairs: dict[tuple[int, int], bool] = {}  # the pair-compatibility table, filled as pairs come up
        self.words = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        names = sorted(self.added, key=len, reverse=True) if specials else []
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.seen_chunks, self.seen_words = Memory(), Memory()

    def fits(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether a then b stay apart: no merge across their border, with a rank below `before`, comes up while they
        are being built. The later built of the two is taken apart first, down to the symbols at the border."""
        limit = len(self.left) if before is None else before
        while True:
            if self.merge.get((a, b), limit) < limit:
                return False
            # Before its own merge, the later one stood as its part at the border. A merge across is then possible if it
            # comes before that merge; of equal ranks, the left one is built first.
            for which in ("b", "a") if b >= a else ("a", "b"):
                if which == "a" and self.right[a] != a:
                    limit, a = min(limit, a), self.right[a]
                    break
                if which == "b" and self.left[b] != b:
                    limit, b = min(limit, b + 1), self.left[b]
                    break
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ranks of the tokens of one word, given in symbols."""
        pairs, shorter, length, n = self.pairs, self.shorter, self.length, len(word)
        tokens: list[int] = []
        open_ = [True] * (n + 1)  # positions that no failed attempt has ended at
        at, token = 0, -2
        longest = self.automaton.iter_long
        while at < n:
            if token == -2:
                end, token = next(longest(word, at))
                if end - length[token] + 1 != at:
                    raise ValueError("a symbol that the vocabulary lacks")
            while token >= 0:
                if open_[at + length[token]]:
                    if not tokens:
                        break
                    pair = (tokens[-1], token)
                    ok = pairs.get(pair)
                    if ok is None:
                        ok = pairs[pair] = self.fits(*pair)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += length[token]
                token = -2
            else:
                open_[at] = False
                token = tokens.pop()
                at -= length[token]
                token = shorter[token]
        return tokens

    def word(self, w: str) -> tuple[int, str, str]:
        """A word's number of tokens, ids in decimal, decoded text; remembered, as words come up in many chunks."""
        seen = self.seen_words
        got = seen.new.get(w)
        if got is None:
            got = seen.old.pop(w, None)
            if got is None:
                s = w.encode("utf-8").decode("latin-1").translate(self.table)
                ids = [self.ids[t] for t in self.encode_word(s[:-1] + self.last[s[-1]])]
                got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            seen.put(w, got)
        return got

    def words_of(self, raw: str) -> list[tuple[int, str, str]]:
        """The words, or added tokens, of a run of text without white space."""
        out: list[tuple[int, str, str]] = []
        for part in self.special.split(raw) if self.special and "<" in raw else (raw,):
            if self.special and part in self.added:
                i = self.added[part]
                out.append((1, str(i), self.decode([i])))
            elif part.isascii():
                out += map(self.word, self.words.findall(part.lower()))
            else:
                # letters are lower-cased one by one, so a sigma that ends a word is the usual one
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += map(self.word, self.words.findall(plain))
        return out

    def chunk(self, raw: str) -> tuple[int, str, str]:
        """The same of a chunk, which is joined from its words; remembered."""
        seen = self.seen_chunks
        got = seen.old.pop(raw, None)
        if got is None:
            words = self.words_of(raw)
            got = words[0] if len(words) == 1 else (sum([w[0] for w in words]), " ".join([w[1] for w in words]), " ".join([w[2] for w in words]))
            if len(self.pairs) >= 2 * MEMORY:
                self.pairs.clear()
        seen.put(raw, got)
        return got

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _CHUNK.findall(text) if _UNIT.search(text) else text.split()

    def chunks(self, text: str | None) -> list[tuple[int, str, str]]:
        seen = self.seen_chunks
        return [seen.new.get(c) or self.chunk(c) for c in self.split(text)]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for c in self.chunks(text) for i in c[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one space, as the library does for a file without a decoder."""
        at, out = self.offsets, self.buffer
        return b" ".join([out[at[i] : at[i + 1]] for i in ids]).decode("utf-8")


_LOADED: dict[tuple[int, bool], Vocabulary] = {}
common.CACHES["bpe"] = _LOADED.clear


def _vocabulary(spec: bytes, specials: bool) -> Vocabulary:
    """One vocabulary a worker, for all its tasks."""
    key = (hash(spec), specials)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(json.loads(spec), specials)
    return _LOADED[key]


def _spec(docs: DataFrame, path: str):
    """The tokenizer file, a few MB whatever the data, read by the driver and sent to the executors."""
    with open(path, "rb") as f:
        return common.ship(docs.sparkSession).sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", specials: bool = True) -> DataFrame:
    """All columns of the table and the token ids of each text as array<int>."""
    spec = _spec(docs, path)

    def run(batches):
        v = _vocabulary(spec.value, specials)
        for b in batches:
            ids = [v.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, out])

    if out in docs.columns:
        docs = docs.drop(out)
    return docs.mapInArrow(run, common.plus(docs, out, "array<int>"))


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of the table and the text of each row of ids (null ids: empty)."""
    spec = _spec(tokens, path)

    def run(batches):
        v = _vocabulary(spec.value, True)
        for b in batches:
            texts = [v.decode(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    if out in tokens.columns:
        tokens = tokens.drop(out)
    return tokens.mapInArrow(run, common.plus(tokens, out, "string"))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", specials: bool = True, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids per row. No shuffle."""
    spec = _spec(docs, path)

    def run(batches):
        v = _vocabulary(spec.value, specials)
        sha = hashlib.sha256
        for b in batches:
            n, ids, back, lists = [], [], [], []
            for t in b.column(1).to_pylist():
                got = v.chunks(t)
                n.append(sum([c[0] for c in got]))
                ids.append(sha(" ".join([c[1] for c in got]).encode()).hexdigest())
                back.append(sha(" ".join([c[2] for c in got]).encode()).hexdigest())
                if with_ids:
                    lists.append(np.array(" ".join([c[1] for c in got]).split(), np.int32))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists) if lists else [], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
