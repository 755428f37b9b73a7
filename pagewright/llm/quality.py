"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of `PASSAGE` words. Every passage is described by numbers of its own (kinds of
characters, word lengths, repetition, common endings by hash) and encoded by a small network. Gated attention, learnt
from document labels alone, weighs the passages; a logistic unit scores the weighted representation.

Defined results: null, empty and wordless texts are a bag of one passage of zeros; without labelled rows of both
classes every score is the share of label 1 (0.5 without any); repeated rows get equal scores; scores depend on the
text alone, all of its passages included. Long texts are described in parts of whole passages, so that memory is bounded
whatever their length (a single word of any length is one passage, which isn't cut).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, learning
from .learning import sigmoid

PASSAGE = 64
ENCODED, ATTENTION, ENDINGS = 24, 12, 48
EPOCHS, BATCH = 30, 64
THRESHOLD = 0.3
#: Bytes that are described at once; each takes some 90 bytes of memory.
MOST = 1 << 19
# Kinds of bytes: 0 other ASCII control, 1 white space, 2 line end, 3 upper, 4 lower, 5 digit, 6 non-ASCII, then
# punctuation marks one by one.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS = 7 + len(_MARKS)
_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = bytes([_b])
    _KIND[_b] = 6 if _b >= 128 else 2 if _c == b"\n" else 1 if _c.isspace() else 3 if _c.isupper() else 4 if _c.islower() else 5 if _c.isdigit() else 7 + _MARKS.index(_c) if _c in _MARKS else 0
_WORD = re.compile(rb"[^ \t\n\r\f\v]+")
FEATURES = _KINDS + 8 + ENDINGS


def ended(text: str | None) -> bytes:
    """A text's bytes, with white space at the end."""
    return (text or "").encode("utf-8", "surrogatepass") + b"\n"


def pieces(raw: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text of about `most` bytes, cut where a passage begins, so that they have the text's own passages. What
    has less than a passage of words in so many bytes stays together."""
    at = 0
    while len(raw) - at > most:
        size, cut = most, len(raw)
        while at + size < len(raw):
            kinds = _KIND[np.frombuffer(raw, np.uint8, size, at)]
            begin = np.flatnonzero(np.diff(((kinds != 1) & (kinds != 2)).astype(np.int8), prepend=0) == 1)
            if (whole := (len(begin) - 1) // PASSAGE * PASSAGE) > 0:
                cut = at + int(begin[whole])
                break
            size *= 2
        yield raw[at:cut]
        at = cut
    if at < len(raw):
        yield raw[at:]


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all passages of some texts, which end in white space, and the text that each passage belongs to. Nothing
    loops over words."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    kinds = _KIND[data]
    solid = (kinds != 1) & (kinds != 2)
    edge = np.diff(solid.astype(np.int8), prepend=0)
    begin = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    text_end = np.cumsum([len(t) for t in texts])
    owner = np.searchsorted(text_end, begin, side="right")  # text of each word
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)])
    n_parts = np.maximum(1, -(-n_words // PASSAGE))
    part0 = np.concatenate([[0], np.cumsum(n_parts)])
    bag = np.repeat(np.arange(len(texts)), n_parts)
    part = part0[owner] + (np.arange(len(begin)) - first[owner]) // PASSAGE
    out = np.zeros((part0[-1], FEATURES), np.float32)
    if not len(begin):
        return out, bag
    # bytes belong to the passage of the word before them, those before the first word to the first one's
    at = np.searchsorted(begin, np.arange(len(data)), side="right") - 1
    text_of = np.repeat(np.arange(len(texts)), np.diff(text_end, prepend=0))
    passage = np.where((at >= 0) & (owner[at] == text_of), part[at], part0[text_of])
    counts = np.bincount(passage * _KINDS + kinds, minlength=part0[-1] * _KINDS).reshape(-1, _KINDS)
    size = np.maximum(counts.sum(axis=1), 1)
    out[:, :_KINDS] = np.sqrt(counts / size[:, None])
    words = np.maximum(np.bincount(part, minlength=part0[-1]), 1)
    length = end - begin
    total = np.bincount(part, length, part0[-1])
    # A hash for each word from its bytes by place, summed over a running total.
    place = (np.arange(len(data)) - begin[at]).clip(0).astype(np.uint64)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    run = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    ident = run[end] - run[begin]
    same = np.zeros(len(begin), bool)
    same[1:] = (ident[1:] == ident[:-1]) & (part[1:] == part[:-1])
    order = np.lexsort((ident, part))
    new = np.ones(len(begin), bool)
    new[1:] = (ident[order][1:] != ident[order][:-1]) | (part[order][1:] != part[order][:-1])
    o = _KINDS
    out[:, o] = np.bincount(part[order], new, part0[-1]) / words  # distinct words
    out[:, o + 1] = np.bincount(part, same, part0[-1]) / words  # a word after itself
    out[:, o + 2] = np.tanh(total / words / 8)
    out[:, o + 3] = np.bincount(part, length == 1, part0[-1]) / words
    out[:, o + 4] = np.bincount(part, length > 20, part0[-1]) / words
    lead, tail = kinds[begin], kinds[end - 1]
    out[:, o + 5] = np.bincount(part, lead == 3, part0[-1]) / words
    out[:, o + 6] = np.bincount(part, tail >= 7, part0[-1]) / words
    out[:, o + 7] = np.tanh(words / PASSAGE)
    # last three bytes of each word, by hash
    a, b, c = (data[np.maximum(end - k, begin)].astype(np.uint64) for k in (1, 2, 3))
    bucket = ((a * np.uint64(65599) + b * np.uint64(257) + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(ENDINGS)
    ends = np.bincount(part * ENDINGS + bucket.astype(np.int64), minlength=part0[-1] * ENDINGS).reshape(-1, ENDINGS)
    out[:, o + 8 :] = np.sqrt(ends / words[:, None])
    out[part0[:-1][n_words == 0]] = 0  # texts without words, whatever stands beside them
    return out, bag


class Model:
    """Passage encoder, gated attention and score."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"w": f(FEATURES, ENCODED, by=FEATURES**-0.5), "c": np.zeros(ENCODED, np.float32), "v": f(ENCODED, ATTENTION, by=0.3), "u": f(ENCODED, ATTENTION, by=0.3), "s": f(ATTENTION, by=0.3), "o": f(ENCODED, by=0.3), "b": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.shift, self.constant = 0.0, None

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> tuple:
        """Logits of n bags; bag numbers rise, and every bag has a passage."""
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ p["w"] + p["c"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        a = (t * g) @ p["s"]
        first = np.searchsorted(bag, np.arange(n))
        e = np.exp(a - np.maximum.reduceat(a, first)[bag])
        w = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(w[:, None] * h, first, axis=0)
        return z @ p["o"] + p["b"], h, t, g, w, z

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean of the bags' log loss."""
        n = len(y)
        logit, h, t, g, w, z = self.forward(x, bag, n)
        p = self.p
        d = ((sigmoid(logit) - y) * weight / n).astype(p["o"].dtype)
        dz = d[:, None] * p["o"]
        dw = (dz[bag] * h).sum(axis=1)
        first = np.searchsorted(bag, np.arange(n))
        da = w * (dw - np.add.reduceat(w * dw, first)[bag])
        dt, dg = da[:, None] * p["s"] * g * (1 - t * t), da[:, None] * p["s"] * t * g * (1 - g)
        dh = w[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T
        dpre = dh * (1 - h * h)
        xs = ((x - self.mean) / self.scale).clip(-8, 8)
        return {"o": z.T @ d, "b": np.array([d.sum()], p["b"].dtype), "s": (t * g).T @ da, "v": h.T @ dt, "u": h.T @ dg, "w": xs.T @ dpre, "c": dpre.sum(axis=0)}

    def logits(self, texts: list[str | None]) -> np.ndarray:
        x, bag = describe([ended(t) for t in texts])
        return self.forward(x, bag, len(texts))[0]

    def long_logit(self, raw: bytes) -> float:
        """The same for one text of any length, part by part: attention needs the largest weight so far, and sums."""
        top, total, z = -np.inf, 0.0, np.zeros(ENCODED)
        p = self.p
        for part in pieces(raw, MOST):
            x, _ = describe([part])
            h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ p["w"] + p["c"])
            a = (np.tanh(h @ p["v"]) * sigmoid(h @ p["u"])) @ p["s"]
            most = max(top, float(a.max()))
            e, old = np.exp(a - most), float(np.exp(top - most))
            total, z, top = total * old + float(e.sum()), z * old + e @ h, most
        return float((z / total) @ p["o"] + p["b"][0])

    def scores(self, texts: list[str | None]) -> list[float]:
        """Of at most 50 texts and `MOST` bytes at once; longer texts one by one, in parts."""
        if self.constant is not None:
            return [self.constant] * len(texts)
        logits: list[float] = []
        some: list[str | None] = []
        size = 0

        def close() -> None:
            if some:
                logits.extend(self.logits(some).tolist())
                some.clear()

        for t in texts:
            n = len(raw := ended(t))
            if some and (len(some) == 50 or size + n > MOST):
                close()
            if not some:
                size = 0
            if n > MOST:
                close()
                logits.append(self.long_logit(raw))
            else:
                some.append(t)
                size += n
        close()
        return sigmoid(np.array(logits, np.float64) + self.shift).tolist()


def train(rows: list[tuple[str, int]], seed: int = 11) -> Model:
    """A model from (text, label) rows. Classes weigh the same while learning; the score is shifted back to the mean of
    both and the share of label 1, so that it isn't drawn to the larger class alone."""
    m = Model(seed)
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        m.constant = float(y.mean()) if len(y) else 0.5
        return m
    bags = [describe([ended(t)])[0] for t, _ in rows]
    every = np.concatenate(bags)
    m.mean, m.scale = every.mean(axis=0), every.std(axis=0) + 0.02
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    adam, r = learning.Adam(m.p, 0.005), np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        perm = r.permutation(len(rows))
        for at in range(0, len(perm), BATCH):
            some = perm[at : at + BATCH]
            x = np.concatenate([bags[i] for i in some])
            bag = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
            grads = m.gradients(x, bag, y[some], weight[some])
            grads["w"] += 1e-4 * m.p["w"]
            adam.step(grads, 0.005 if epoch < EPOCHS * 2 // 3 else 0.0015)
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", **bounds) -> Model:
    """A model learnt from the training rows of the labels (see `learning.sample` for the bound)."""
    return train(learning.sample(docs, labels, label, **bounds))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns and the quality score of each whole text. No shuffle; the model (some KB) is broadcast."""
    sent = common.ship(docs.sparkSession).sparkContext.broadcast(model)
    docs = docs.drop(out)

    def run(batches):
        common.only("quality")
        for b in batches:
            got = sent.value.scores(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(run, common.plus(docs, out, "double"))
