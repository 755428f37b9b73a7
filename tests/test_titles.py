"""Similar titles as a join of segments: equal to comparing all pairs, and few comparisons."""

import random
import string

import pytest
from pyspark.sql import functions as F

from pagewright.operators import document as D


def near_and_far(seed, n, letters):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        base = "".join(r.choice(letters) for _ in range(r.randint(1, 40)))
        out.add(base)
        for _ in range(r.randint(0, 4)):
            t = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 5))):
                if t and r.random() < 0.5:
                    del t[r.randrange(len(t))]
                else:
                    t.insert(r.randint(0, len(t)), r.choice(letters))
            out.add("".join(t))
    return sorted(out - {""})


@pytest.mark.parametrize("similar", [60.0, 70.0, 85.0, 90.0, 97.5, 100.0])
def test_no_similar_pair_is_missed(spark, similar):
    titles = near_and_far(int(similar), 250, "abé𝄞 ")
    docs = spark.createDataFrame([(d, t) for d in (1, None) for t in titles], "doc_id long, t string").filter("doc_id = 1")
    found = {(r.t, r.u) for r in D.similar_pairs(docs, similar).collect()}
    assert all(len(t) <= len(u) and t != u for t, u in found)
    every = {(t, u) for t in titles for u in titles if t != u and (len(t), t) < (len(u), u) and D.indel_ratio(t, u) >= similar}
    assert every <= found


def test_pairs_stay_within_documents(spark):
    docs = spark.createDataFrame([(1, "a title of one"), (2, "a title of two"), (2, "a title of twos")], "doc_id long, t string")
    assert [(r.doc_id, r.t, r.u) for r in D.similar_pairs(docs).collect()] == [(2, "a title of two", "a title of twos")]
    assert D.similar_pairs(docs.limit(0)).collect() == []
    assert D.similar_pairs(docs, 60.0).count() == 1


def test_many_different_titles_make_few_pairs(spark):
    """10,000 different titles in one document: a small part of the 50 million pairs is compared."""
    r = random.Random(8)
    titles = {"".join(r.choice(string.ascii_lowercase + " ") for _ in range(r.randint(20, 40))) for _ in range(10_000)}
    docs = spark.createDataFrame([(1, t) for t in titles] + [(1, t + "!") for t in sorted(titles)[:50]], "doc_id long, t string")
    found = D.similar_pairs(docs)
    assert 50 <= found.count() < 100_000
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_common_titles_of_similar_ones(spark):
    rows = [(1, i, "Title", f"Annual report of the house, part {c}") for i, c in enumerate("abcde")] + [(1, 9, "Title", "Something else")]
    d = spark.createDataFrame(rows, "doc_id long, index int, block_type string, text string")
    assert sorted(r["index"] for r in D.common_titles(d).collect()) == [0, 1, 2, 3, 4]
    assert D.common_titles(d.filter(F.col("index") < 3)).collect() == []
