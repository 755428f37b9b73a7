"""Topic segments: marked texts, a slow form of the same rules, odd rows, and the plan."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.functions import chunking, topics

TOPICS = ["harbour ship sail crew anchor deck mast captain", "oven bread flour yeast dough crust baker salt", "orbit rocket planet moon launch probe comet star"]


def topical(seed, parts, lines):
    """Paragraphs about one topic after the other."""
    r = random.Random(seed)
    out = []
    for n, part in enumerate(parts):
        words = TOPICS[n % 3].split()
        out.append([" ".join(r.choice(words) for _ in range(8)) + "." for _ in range(part)])
    return ("\n\n" if lines else " ").join((" " if not lines else "\n").join(p) for p in out)


def slow(text, width=20, block=10):
    """The same rules in plain Python, for one text."""
    x = re.findall(r"\w+\W*", text)
    if not text.strip():
        return []
    n = -(-len(x) // width)
    cuts = set()
    if n >= 3:
        stop = set(chunking.STOP_WORDS)
        words = [re.match(r"\w+", p).group().lower() for p in x]
        count = [Counter(w for w in words[i * width : (i + 1) * width] if w not in stop) for i in range(n)]
        s = []
        for g in range(1, n):
            k = min(block, g, n - g)
            a, b = sum(count[g - k : g], Counter()), sum(count[g : g + k], Counter())
            norm = math.sqrt(float(sum(v * v for v in a.values())) * float(sum(v * v for v in b.values())))
            s.append(sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0)
        s = [((s[i - 1] if i else v) + v + (s[i + 1] if i + 1 < len(s) else v)) / 3 for i, v in enumerate(s)]
        depth = []
        for i, v in enumerate(s):
            left = right = i
            while left and s[left - 1] >= s[left]:
                left -= 1
            while right + 1 < len(s) and s[right + 1] >= s[right]:
                right += 1
            depth.append(s[left] + s[right] - 2 * v)
        mean = sum(depth) / len(depth)
        cut = max(mean - math.sqrt(sum((d - mean) ** 2 for d in depth) / len(depth)) / 2, 0.0)
        breaks = [i + 1 for i, p in enumerate(x) if "\n" in p]
        for i, d in enumerate(depth):
            if d > cut and all(d > e for e in depth[max(0, i - 3) : i]) and all(d >= e for e in depth[i + 1 : i + 4]):
                at = (i + 1) * width
                cuts.add(min(breaks, key=lambda b: (abs(b - at), b)) if breaks else at)
    ends = [0, *sorted(c for c in cuts if 0 < c < len(x)), len(x)]
    lead = lambda i: x[i][x[i].rfind("\n") + 1 :] if "\n" in x[i] else ""
    out = []
    for a, b in zip(ends, ends[1:]):
        own = "".join(x[a:b])
        own = own[: len(own) - len(lead(b - 1))] if b < len(x) else own
        out.append((re.match(r"\W*", text).group() if a == 0 else lead(a - 1)) + own)
    return out


def run(spark, texts, **options):
    got = {i: [] for i in range(len(texts))}
    rows = topics.segments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        got[r.doc_id].append(r.chunk)
    return [got[i] for i in range(len(texts))]


def test_marked_topics(spark):
    for got in run(spark, [topical(1, [30, 30, 30], True), topical(2, [25, 40, 30], True)]):
        # no segment goes over a border of topics; one topic may be more than one segment
        kinds = [{i for i, t in enumerate(TOPICS) for w in c.split() if w.strip(".") in t.split()} for c in got]
        assert all(len(k) == 1 for k in kinds) and len(got) <= 6
        assert sorted(set().union(*kinds)) == [0, 1, 2]


@pytest.mark.parametrize(("width", "block", "tile"), [(20, 10, 64), (5, 3, 4), (20, 2, 1)])
def test_equal_to_the_slow_form(spark, monkeypatch, width, block, tile):
    monkeypatch.setattr(topics, "TILE", tile)
    r = random.Random(width)
    texts = [topical(i, [r.randint(1, 25) for _ in range(r.randint(1, 5))], i % 2) for i in range(25)]
    texts += ["- a\n- b\n\n• " + "word the of\n - " * 60 + "end --", "the of and " * 80, "x" * 100, "a b c", "\n \n"]
    assert run(spark, texts, width=width, block=block) == [slow(t, width, block) for t in texts]


def test_odd_rows(spark):
    t = topical(4, [30, 30], True)
    docs = spark.createDataFrame([(None, t, 1), (None, t, 1), (1, t, 2), (2, None, 3), (3, "", 3), (4, " \n", 3), (5, "!?", 3), (None, None, 0)], "doc_id long, text string, g int")
    got = topics.segments(docs).collect()
    n = len(slow(t))
    assert n > 1 and sorted((str(r.doc_id), r.pos) for r in got) == [*[("1", i) for i in range(n)], ("5", 0), *[("None", i // 2) for i in range(2 * n)]]
    assert [r.chunk for r in got if r.doc_id == 5] == ["!?"]
    assert "".join(r.chunk for r in sorted(got, key=lambda r: r.pos) if r.doc_id == 1) == t
    assert topics.segments(docs.limit(0)).collect() == []
    assert chunking.chunk(docs, "topic").count() == 3 * n + 1


def test_a_long_text_is_spread(spark):
    """The rows of one text go to many tasks."""
    long = topical(5, [400] * 12, True)
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    counts = topics.block_words(docs, "doc_id", "text", 20, [])
    n = counts.agg(F.max("n_blocks")).first()[0]
    assert n > 20 * topics.TILE
    scores = topics.gap_scores(counts, 10)
    assert scores.count() == n - 1
    plan = topics.segments(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


def test_counts_never_move(spark):
    """Texts move, once to be counted and once to be cut; counts of words stay where their text is."""
    docs = spark.createDataFrame([(1, topical(5, [60] * 4, True)), (None, "a b c")], "doc_id long, text string")
    plan = topics.segments(docs)._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moves and not any(f"{c}#" in x.split("hashpartitioning(")[1] for x in moves for c in ("tile", "p", "w", "g", "n_blocks")), moves
