"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as a word vector and as the sum of vectors of its character 3-, 4- and 5-grams (both hashed). A window
of `LENGTH` words goes through a recurrent layer in each direction; attention pools the states; a logistic unit scores
the window. The windows that begin at every word are scored, so that every phrase of up to `LENGTH` words is whole in
one; a document's score is its highest window's, calibrated on the training rows.

Learning, from windows that begin every `STEP` words and a last one: a window of a toxic document need not be toxic. In every round the windows of toxic documents that score
highest stand for them, against windows of the other documents, the highest among them included. The first round's
scores are log odds of character grams.

Defined results: null, empty and wordless texts score 0; without labelled rows of both classes
every score is the share of label 1 (0 without any); repeated rows get equal scores; scores depend on the text alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, learning
from .learning import sigmoid

LENGTH, STEP = 20, 10
HIDDEN, CHAR_DIM, WORD_DIM, ATTENTION = 8, 8, 4, 8
CHAR_BUCKETS, WORD_BUCKETS = 1 << 15, 1 << 12
ROUNDS, EPOCHS, BATCH = 4, 3, 128
#: Words whose input a worker remembers; no result depends on it.
MEMORY = 400_000
#: Words of the texts that are worked on together; a multiple of STEP.
PART = 40_000
#: Windows that are scored at once.
AT_ONCE = 2048
#: Below the highest estimate by which a window can still be a text's highest. An estimate that is off by more than a
#: quarter of it, in a window that was looked at, has all windows of the text scored.
MARGIN = 0.1
THRESHOLD = 0.5
# ASCII but letters and digits becomes a space.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, as bytes."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def grams(words: list[bytes], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all character grams, the word each belongs to, and each word's own bucket; words in order."""
    some = [_grams(words[a : a + at_once]) for a in range(0, len(words), at_once)]
    who = [w + np.int32(i * at_once) for i, (_, w, _) in enumerate(some)]
    empty = np.zeros(0, np.int32)
    return np.concatenate([empty, *(f for f, _, _ in some)]), np.concatenate([empty, *who]), np.concatenate([empty, *(o for _, _, o in some)])


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(w) + 2 for w in words])
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    end = ends[word]
    buckets, owners = [], []
    h = np.zeros(len(data), np.uint64)
    at = np.arange(len(data))
    shift = np.uint64(64 - CHAR_BUCKETS.bit_length() + 1)
    for n in range(1, 6):
        size = len(data) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
        if n >= 3:
            ok = at[:size] + n <= end[:size]
            buckets.append(((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32))
            owners.append(word[:size][ok])
    own = np.zeros(len(words), np.uint64)
    mixed = (data + np.uint64(1)) * (at.astype(np.uint64) - np.repeat(ends - lengths, lengths).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    own = np.add.reduceat(mixed * np.uint64(0x9E3779B97F4A7C15), ends - lengths)
    own = (own >> np.uint64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int32)
    flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
    who = np.concatenate(owners).astype(np.int32) if owners else np.zeros(0, np.int32)
    order = np.argsort(who, kind="stable")
    return flat[order], who[order], own


def starts_of(n: int) -> list[int]:
    """Where the windows begin that n words are learnt from."""
    return [*range(0, n - LENGTH, STEP), n - LENGTH] if n > LENGTH else [0]


def pieces(words: list[bytes]) -> Iterator[list[bytes]]:
    """Parts of a text whose windows together are the text's windows; a text of up to PART words is one."""
    if words and len(words) <= PART:
        yield words
    else:
        for a in range(0, len(words) - LENGTH + 1, PART):
            # No piece begins where fewer than LENGTH words are left: the one before runs to the end of the text.
            yield words[a:] if len(words) - a < PART + LENGTH else words[a : a + PART + LENGTH - 1]


class Encoder:
    """The network. Inputs of distinct words are computed once (`project`), windows run over their numbers."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        n, d = HIDDEN, CHAR_DIM + WORD_DIM
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"chars": f(CHAR_BUCKETS, CHAR_DIM, by=0.02), "words": f(WORD_BUCKETS, WORD_DIM, by=0.05)}
        for side in "fb":
            self.p |= {f"x{side}": f(d, 3 * n, by=d**-0.5), f"h{side}": f(n, 3 * n, by=0.5 * n**-0.5), f"c{side}": np.zeros(3 * n, np.float32)}
        self.p |= {"a": f(2 * n, ATTENTION, by=0.5), "s": f(ATTENTION, by=0.5), "o": f(2 * n, by=0.5), "b": np.full(1, -1.0, np.float32)}
        self.slope, self.shift, self.constant = 1.0, 0.0, None

    def vectors(self, g: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        flat, who, own = g
        out = np.zeros((len(own), CHAR_DIM + WORD_DIM), np.float32)
        if len(flat):
            for a in range(0, len(own), 20_000):  # in parts, to bound memory
                lo, hi = np.searchsorted(who, [a, min(a + 20_000, len(own))])
                if hi > lo:
                    first = np.flatnonzero(np.diff(who[lo:hi], prepend=-1))
                    out[who[lo:hi][first], :CHAR_DIM] = np.add.reduceat(self.p["chars"][flat[lo:hi]], first, axis=0)
        out[:, CHAR_DIM:] = self.p["words"][own]
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs to the gates, by direction and word."""
        return np.stack([x @ self.p["xf"] + self.p["cf"], x @ self.p["xb"] + self.p["cb"]])

    def run(self, gates: np.ndarray, idx: np.ndarray, valid: np.ndarray | None, keep: bool = False):
        """Logits of windows. idx: numbers of words, windows by places; valid: which places have words (None: all)."""
        n, p = HIDDEN, self.p
        size, length = idx.shape
        states = np.zeros((length, size, 2 * n), np.float32)
        saved = []
        for side, own in zip("fb", gates):
            u, at = p[f"h{side}"], 0 if side == "f" else n
            h = np.zeros((size, n), np.float32)
            steps = []
            for t in range(length) if side == "f" else range(length - 1, -1, -1):
                x, g = own[idx[:, t]], h @ u
                zr = sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
                z, r = zr[:, :n], zr[:, n:]
                new = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
                out = new + z * (h - new)
                if valid is not None:
                    out = np.where(valid[:, t, None], out, h)
                if keep:
                    steps.append((t, h, g[:, 2 * n :], z, r, new))
                h = out
                states[t, :, at : at + n] = h
            saved.append(steps)
        e = np.tanh(states @ p["a"])
        s = e @ p["s"]
        if valid is not None:
            s = np.where(valid.T, s, -1e9)
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbk->bk", w, states)
        logit = pooled @ p["o"] + p["b"]
        return (logit, (states, saved, e, w, pooled)) if keep else logit

    def slide(self, x: np.ndarray) -> np.ndarray:
        """Logits of the windows that begin at every place, as `run` gives them. x: inputs to the gates, by direction,
        gate and place, which are changed."""
        n, p, half, one = HIDDEN, self.p, np.float32(0.5), np.float32(1)
        size = x.shape[2] - LENGTH + 1
        states, g = np.empty((LENGTH, 2 * n, size), np.float32), np.empty((3 * n, size), np.float32)
        # A gate is half of 1 + tanh of half its input; halves are taken out of the loop.
        zr, new = g[: 2 * n], g[2 * n :]
        x[:, : 2 * n] *= half
        for side, own in zip("fb", x):
            u, at = np.ascontiguousarray(p[f"h{side}"].T) * half, 0 if side == "f" else n
            h = np.zeros((n, size), np.float32)
            for t in range(LENGTH) if side == "f" else range(LENGTH - 1, -1, -1):
                now = own[:, t : t + size]
                np.matmul(u, h, out=g)
                zr += now[: 2 * n]
                np.tanh(zr, out=zr)
                zr += one
                new *= zr[n:]
                new += now[2 * n :]
                np.tanh(new, out=new)
                out = states[t, at : at + n]
                np.subtract(h, new, out=out)
                out *= zr[:n]
                out *= half
                out += new
                h = out
        s, v = np.empty((LENGTH, size), np.float32), np.empty((LENGTH, size), np.float32)
        a = np.ascontiguousarray(p["a"].T)
        e = np.empty((len(a), size), np.float32)
        for t in range(LENGTH):
            np.matmul(a, states[t], out=e)
            np.tanh(e, out=e)
            np.matmul(p["s"], e, out=s[t])
            np.matmul(p["o"], states[t], out=v[t])
        s -= s.max(axis=0)
        np.exp(s, out=s)
        v *= s
        return v.sum(axis=0) / s.sum(axis=0) + p["b"]

    def _estimator(self) -> tuple:
        """What `estimate` needs of the parameters: scale, bound and steps of the powers, and matrices for states in (0, 1)."""
        n, p = HIDDEN, self.p
        most = max(float(np.abs(p[k]).sum(axis=0).max()) for k in ("hf", "hb")) * 2
        k = 5
        while 1.9 * 2**k < 2 * most + 10:
            k += 1
        # y - 1 for y = v / 2**k, over the square root of 2; candidates and attention go through tanh(v) = 2 * sigmoid(2 * v) - 1
        scale = 0.5**0.5 / 2**k
        by = np.repeat(np.float32([scale, 2 * scale]), [2 * n, n])[:, None]
        sides = []
        for side in "fb":
            u = p[f"h{side}"].T * by
            sides.append((2 * u, -u.sum(axis=1, keepdims=True)))
        a = p["a"].T * np.float32(2 * scale)
        last = np.concatenate([2 * a, 2 * p["o"][None]])
        one = np.concatenate([-a.sum(axis=1, keepdims=True) - np.float32(0.5**0.5), -p["o"].sum(keepdims=True)[None]])
        at = lambda m, c, where: np.ascontiguousarray(np.insert(m, where, c.T, axis=1), dtype=np.float32)
        return by, 1.9 * 2**k - most, k, at(*sides[0], n), at(*sides[1], 0), at(last, one, n)

    def estimate(self, x: np.ndarray, with_: tuple) -> np.ndarray:
        """About what `slide` gives, in some half of the time. sigmoid(v) is 1 / (1 + q**K), where q, near to exp(-v / K), is a
        square and a half, so that powers are squares; states h are kept as (h + 1) / 2, which needs sigmoids only."""
        n, p, one, half = HIDDEN, self.p, np.float32(1), np.float32(0.5)
        by, most, k, f, b, last = with_
        size = x.shape[2] - LENGTH + 1

        def sigmoids(v: np.ndarray) -> None:
            np.multiply(v, v, out=v)
            np.add(v, half, out=v)
            for _ in range(k):
                np.multiply(v, v, out=v)
            np.add(v, one, out=v)
            np.divide(one, v, out=v)

        # forward states, ones, backward states
        states, g = np.empty((LENGTH, 2 * n + 1, size), np.float32), np.empty((3 * n, size), np.float32)
        states[:, n] = 1
        zr, new = g[: 2 * n], g[2 * n :]
        np.clip(x, -most, most, out=x)
        x *= by
        x -= np.float32(0.5**0.5)
        with np.errstate(over="ignore"):
            for own, m, u, at, order in ((x[0], f, slice(0, n + 1), slice(0, n), range(LENGTH)), (x[1], b, slice(n, 2 * n + 1), slice(n + 1, 2 * n + 1), range(LENGTH - 1, -1, -1))):
                before = np.full((n + 1, size), half)
                before[0 if at.start else n] = 1
                h = before[1:] if at.start else before[:n]
                # the constant of z and r goes with the inputs
                for t in order:
                    now = own[:, t : t + size]
                    np.matmul(m, before, out=g)
                    zr += now[: 2 * n]
                    sigmoids(zr)
                    new *= zr[n:]
                    new += now[2 * n :]
                    sigmoids(new)
                    out = states[t, at]
                    np.subtract(h, new, out=out)
                    out *= zr[:n]
                    out += new
                    h, before = out, states[t, u]
            s, v, e = np.empty((LENGTH, size), np.float32), np.empty((LENGTH, size), np.float32), np.empty((len(last), size), np.float32)
            by_two = p["s"] * 2
            for t in range(LENGTH):
                np.matmul(last, states[t], out=e)
                v[t] = e[-1]
                np.clip(e[:-1], -1.3, 1.3, out=e[:-1])
                sigmoids(e[:-1])
                np.matmul(by_two, e[:-1], out=s[t])
        s -= s.max(axis=0)
        np.exp(s, out=s)
        v *= s
        return v.sum(axis=0) / s.sum(axis=0) + p["b"]

    def highest(self, gates: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
        """The highest logit of each text, given as numbers of its words. All full windows are estimated, sliding over all
        texts together, and those that can be their text's highest are run; texts shorter than a window are run with a mask."""
        best = np.full(len(docs), -np.inf, np.float64)
        full = [i for i, x in enumerate(docs) if len(x) >= LENGTH]
        if full:
            flat = np.concatenate([docs[i] for i in full])
            who = np.repeat(full, [len(docs[i]) for i in full])
            inside = who[: len(flat) - LENGTH + 1] == who[LENGTH - 1 :]
            starts, with_ = np.flatnonzero(inside), self._estimator()
            about = self._sliding(gates, flat, inside, lambda x: self.estimate(x, with_), 4 * AT_ONCE)[starts]
            of, unknown = who[starts], ~np.isfinite(about)
            top, off = np.full(len(docs), -np.inf, np.float32), np.zeros(len(docs), bool)
            about[unknown], off[of[unknown]] = -np.inf, True
            np.maximum.at(top, of, about)
            maybe = np.flatnonzero((about >= top[of] - np.float32(MARGIN)) & ~off[of])
            for a in range(0, len(maybe), AT_ONCE):
                some = maybe[a : a + AT_ONCE]
                got = self.run(gates, flat[starts[some][:, None] + np.arange(LENGTH)], None)
                np.maximum.at(best, of[some], got)
                off[of[some][~(np.abs(got - about[some]) <= MARGIN / 4)]] = True
            if off.any():
                again = inside & off[who[: len(inside)]]
                np.maximum.at(best, who[: len(inside)][again], self._sliding(gates, flat, again, self.slide, AT_ONCE)[again])
        if short := [i for i, x in enumerate(docs) if len(x) < LENGTH]:
            idx, valid, doc = _windows([docs[i] for i in short])
            np.maximum.at(best, np.array(short)[doc], self.run(gates, idx, valid))
        return best

    def _sliding(self, gates: np.ndarray, flat: np.ndarray, wanted: np.ndarray, f, at_once: int) -> np.ndarray:
        """What f gives for windows over `flat`, in parts that have wanted ones."""
        out = np.full(len(wanted), -np.inf, np.float32)
        step = at_once - LENGTH + 1  # windows over so many places
        for a in range(0, len(wanted), step):
            some = wanted[a : a + step]
            if some.any():
                x = gates[:, flat[a : a + len(some) + LENGTH - 1]]
                out[a : a + len(some)] = f(np.ascontiguousarray(x.transpose(0, 2, 1)))
        return out

    def gradients(self, gates, idx, valid, kept, dlogit) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the loss, with respect to the parameters and to the gate inputs of each word."""
        n, p = HIDDEN, self.p
        states, saved, e, w, pooled = kept
        length = idx.shape[1]
        g = {"o": pooled.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * p["o"]
        dw = np.einsum("bk,tbk->tb", dpooled, states)
        dstates = w[:, :, None] * dpooled
        ds = w * (dw - (w * dw).sum(axis=0))
        de = ds[:, :, None] * p["s"] * (1 - e * e)
        g["s"] = np.einsum("tb,tbk->k", ds, e)
        g["a"] = np.einsum("tbi,tbk->ik", states, de)
        dstates += de @ p["a"].T
        dgates = np.zeros_like(gates)
        for steps, side, own, at in ((saved[0], "f", dgates[0], 0), (saved[1], "b", dgates[1], n)):
            u = p[f"h{side}"]
            du = np.zeros_like(u)
            dh = np.zeros((len(idx), n), np.float32)
            at_word = np.zeros((length, len(idx), 3 * n), np.float32)
            for t, h, gn, z, r, new in reversed(steps):
                dout = dh + dstates[t, :, at : at + n]
                live = np.ones((len(idx), 1), np.float32) if valid is None else valid[:, t, None].astype(np.float32)
                d = dout * live
                dnew = d * (1 - z) * (1 - new * new)
                dz = d * (h - new) * z * (1 - z)
                dr = dnew * gn * r * (1 - r)
                full = np.concatenate([dz, dr, dnew * r], axis=1)
                du += h.T @ full
                dh = dout * (1 - live) + d * z + full @ u.T
                at_word[t, :, : 2 * n], at_word[t, :, 2 * n :] = full[:, : 2 * n], dnew
            words, sums = learning.summed(at_word.reshape(-1, 3 * n), idx.T.reshape(-1))
            own[words] = sums
            g[f"h{side}"] = du
        return g, dgates


def _windows(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of documents given as word numbers: numbers, valid places, and the document of each."""
    doc = np.repeat(np.arange(len(numbers)), [len(starts_of(len(x))) for x in numbers])
    idx, valid = np.zeros((len(doc), LENGTH), np.int32), np.zeros((len(doc), LENGTH), bool)
    k = 0
    for x in numbers:
        for s in starts_of(len(x)):
            part = x[s : s + LENGTH]
            idx[k, : len(part)], valid[k, : len(part)] = part, True
            k += 1
    return idx, valid, doc


def train(rows: list[tuple[str, int]], seed: int = 7) -> Encoder:
    """A network from (text, label) rows."""
    net = Encoder(seed)
    rows = [r for r in rows if words_of(r[0])]
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t, _ in rows]
    flat, who, own = grams(list(number))
    begin = np.searchsorted(who, np.arange(len(number) + 1))
    size = np.diff(begin)

    # Log odds of each gram among documents, with as many rows as PRIOR added at the rate of all documents.
    seen = np.zeros((2, CHAR_BUCKETS))
    for x, label in zip(docs, y):
        seen[label, np.unique(np.concatenate([flat[begin[w] : begin[w + 1]] for w in np.unique(x)]))] += 1
    n0, n1, prior = (y == 0).sum(), (y == 1).sum(), 3.0
    rate = seen.sum(axis=0) / len(y) + 1e-9
    odds = np.log((seen[1] + prior * rate) / (n1 + prior)) - np.log((seen[0] + prior * rate) / (n0 + prior))
    odds[seen.sum(axis=0) < 2] = 0.0

    idx, valid, doc = _windows(docs)
    word_odds = np.add.reduceat(np.append(odds.astype(np.float32)[flat], np.float32(0)), np.minimum(begin[:-1], len(flat))) * (np.diff(begin) > 0)
    score = np.where(valid, word_odds[idx], -9).max(axis=1)
    adam = learning.Adam(net.p, 0.01)
    r = np.random.default_rng(seed)
    toxic = y[doc] == 1
    for k in range(ROUNDS):
        picked, target = [], []
        by = np.lexsort((-score, doc))
        first = np.flatnonzero(np.diff(doc[by], prepend=-1))
        rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        top = np.zeros(len(doc), np.int64)
        top[by] = rank
        # of a toxic document its best window, and others that already score as toxic; of others the best and some more
        positive = np.flatnonzero(toxic & ((top == 0) | ((score > 0) & (k > 0) & (top < 4))))
        negative = np.flatnonzero(~toxic & ((top < 2) | (r.random(len(doc)) < 0.15)))
        picked = np.concatenate([positive, negative])
        target = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))]).astype(np.float32)
        weight = np.where(target > 0, 0.5 / len(positive), 0.5 / len(negative)) * len(target)
        for epoch in range(EPOCHS):
            perm = r.permutation(len(picked))
            for a in range(0, len(perm), BATCH):
                some = perm[a : a + BATCH]
                rows_ = picked[some]
                words, local = np.unique(idx[rows_], return_inverse=True)
                local = local.reshape(len(some), LENGTH)
                count = size[words]
                part_who = np.repeat(np.arange(len(words)), count)
                part_flat = flat[np.arange(len(part_who)) + np.repeat(begin[words] - (np.cumsum(count) - count), count)]
                part = (part_flat, part_who, own[words])
                x = net.vectors(part)
                gates = net.project(x)
                logit, kept = net.run(gates, local, valid[rows_], keep=True)
                dlogit = ((sigmoid(logit) - target[some]) * weight[some] / len(some)).astype(np.float32)
                grads, dgates = net.gradients(gates, local, valid[rows_], kept, dlogit)
                grads |= {"xf": x.T @ dgates[0], "cf": dgates[0].sum(axis=0), "xb": x.T @ dgates[1], "cb": dgates[1].sum(axis=0)}
                dx = dgates[0] @ net.p["xf"].T + dgates[1] @ net.p["xb"].T
                grads["chars"] = learning.summed(dx[part_who, :CHAR_DIM], part_flat)
                grads["words"] = learning.summed(dx[:, CHAR_DIM:], own[words])
                adam.step(grads, 0.01 * (0.5 if k >= ROUNDS - 1 else 1.0))
        gates = net.project(net.vectors((flat, who, own)))
        score = np.concatenate([net.run(gates, idx[a : a + AT_ONCE], valid[a : a + AT_ONCE]) for a in range(0, len(idx), AT_ONCE)])
    best = np.concatenate([net.highest(gates, docs[a : a + 100]) for a in range(0, len(docs), 100)])
    net.slope, net.shift = learning.calibrate(best, y, np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y))
    return net


class _Numbers(dict):
    """Words by the order in which they came."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


class Scorer:
    """Scores batches of texts with a trained network; remembers the inputs of words."""

    def __init__(self, net: Encoder) -> None:
        self.net, self.number, self.ready = net, _Numbers(), 0
        self.gates = np.zeros((2, MEMORY, 3 * HIDDEN), np.float32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def _project(self) -> None:
        """Inputs of the words that are new."""
        new = list(itertools.islice(self.number, self.ready, None))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.gates[:, self.ready : self.ready + len(part)] = self.net.project(self.net.vectors(grams(part)))
            self.ready += len(part)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of texts. Texts are worked on in parts of bounded words, so that memory doesn't follow their length."""
        if self.net.constant is not None:
            return [self.net.constant] * len(texts)
        best = np.full(len(texts), -np.inf)
        parts: list[tuple[int, list[bytes]]] = []
        held = 0
        for i, t in enumerate(texts):
            for part in pieces(words_of(t)):
                parts.append((i, part))
                held += len(part)
                if held >= PART:
                    self._score(parts, best)
                    parts, held = [], 0
        if parts:
            self._score(parts, best)
        # a text without words has no window, and scores 0
        return np.where(np.isneginf(best), 0.0, sigmoid(self.net.slope * np.maximum(best, -1e6) + self.net.shift)).tolist()

    def _score(self, parts: list[tuple[int, list[bytes]]], best: np.ndarray) -> None:
        if len(self.number) > MEMORY - 2 * PART - LENGTH:  # up to PART - 1 words are held when a piece of up to PART + LENGTH - 1 comes
            self.number, self.ready = _Numbers(), 0
        docs = [self._numbers(w) for _, w in parts]
        if len(self.number) > self.ready:
            self._project()
        np.maximum.at(best, [i for i, _ in parts], self.net.highest(self.gates, docs))


def score(docs: DataFrame, net: Encoder, text: str = "text", out: str = "score") -> DataFrame:
    """All columns and the toxicity score of each whole text. No shuffle; the network (about 1 MB) is broadcast."""
    model = common.ship(docs.sparkSession).sparkContext.broadcast(net)
    docs = docs.drop(out)

    def run(batches):
        common.only("toxicity")
        scorer = Scorer(model.value)
        for b in batches:
            got = scorer.scores(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(run, common.plus(docs, out, "double"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", **bounds) -> Encoder:
    """A network learnt from the training rows of the labels (see `learning.sample` for the bound)."""
    net = train(learning.sample(docs, labels, label, **bounds))
    learning.give_back()
    return net


def remove(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    name = "score_of_toxicity"
    return score(docs, fit(docs, labels), text, name).filter(F.col(name) < threshold).drop(name)
