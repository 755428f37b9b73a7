"""Quality: parts of long texts, a slow scorer, gradients, and memory."""

import math
import random
import subprocess
import sys

import numpy as np
import pytest

from pagewright.llm import quality
from pagewright.llm.learning import sigmoid


def text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(["word", "Word,", "é", "1234", "...", "x" * 30, "THE"]) + r.choice([" ", " ", "\n", "  \t"]) for _ in range(n))


def slow_logit(m, raw):
    """One bag, passage by passage, in plain Python."""
    x, _ = quality.describe([raw])
    p = {k: v.astype(float).tolist() for k, v in m.p.items()}
    hidden, weights = [], []
    for row in ((x - m.mean) / m.scale).clip(-8, 8).tolist():
        h = [math.tanh(sum(v * p["w"][i][j] for i, v in enumerate(row)) + p["c"][j]) for j in range(quality.ENCODED)]
        a = 0.0
        for k in range(quality.ATTENTION):
            t = math.tanh(sum(v * p["v"][i][k] for i, v in enumerate(h)))
            g = 1 / (1 + math.exp(-sum(v * p["u"][i][k] for i, v in enumerate(h))))
            a += t * g * p["s"][k]
        hidden.append(h)
        weights.append(a)
    e = [math.exp(a - max(weights)) for a in weights]
    z = [sum(w * h[j] for w, h in zip(e, hidden)) / sum(e) for j in range(quality.ENCODED)]
    return sum(v * o for v, o in zip(z, p["o"])) + p["b"][0]


@pytest.mark.parametrize("most", [1, 100, 997, 1 << 20])
def test_parts_have_the_texts_own_passages(most):
    for raw in (quality.ended(text(3, 2000)), quality.ended("  \n" + text(4, 63)), quality.ended(None), quality.ended("x" * 5000), quality.ended(" " * 3000 + "a b")):
        parts = list(quality.pieces(raw, most))
        assert b"".join(parts) == raw
        assert np.array_equal(np.concatenate([quality.describe([x])[0] for x in parts]), quality.describe([raw])[0])
        if len(raw) > 6000 and most < 1000:
            assert len(parts) > 10


def test_scores_by_parts_and_slowly(monkeypatch):
    m = quality.train([(text(i, 80 + i), i % 2) for i in range(20)])
    texts = [text(9, 700), None, "", text(10, 5), text(11, 3000), "short"]
    whole = m.scores(texts)
    slow = [1 / (1 + math.exp(-slow_logit(m, quality.ended(t)) - m.shift)) for t in texts]
    assert np.allclose(whole, slow, atol=1e-4)
    monkeypatch.setattr(quality, "MOST", 500)
    assert np.allclose(m.scores(texts), whole, atol=1e-5)


def test_gradients():
    m = quality.Model(3)
    x, bag = quality.describe([quality.ended(text(i, 100 * i + 1)) for i in range(5)])
    m.p = {k: v.astype(np.float64) + 0.01 for k, v in m.p.items()}
    m.mean, m.scale = x.mean(axis=0).astype(np.float64), x.std(axis=0).astype(np.float64) + 0.1
    y, weight = np.array([0, 1, 1, 0, 1.0]), np.array([1, 2, 0.5, 1, 1.0])

    def loss():
        s = sigmoid(m.forward(x, bag, 5)[0])
        return float(-(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean())

    got, r = m.gradients(x, bag, y, weight), np.random.default_rng(0)
    for name, g in got.items():
        flat = m.p[name].reshape(-1)
        for i in r.choice(flat.size, min(8, flat.size), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-6 + 1e-4 * abs(g.reshape(-1)[i]), name


def test_memory_of_a_long_text():
    """16 MB of text take less than 200 MB beyond what a short one takes."""
    code = """
import resource
from pagewright.llm import quality
m = quality.Model()
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
t = "some words of a text, and more. " * 520_000
m.scores(["short"])
before = peak()
m.scores([t, t[:1_000_000]] + ["x y " * 200_000] * 10)
print(peak() - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(got.stdout) < 200
