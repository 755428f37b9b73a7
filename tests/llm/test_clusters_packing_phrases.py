"""Sort-means, packing and collocations: brute force, SQL on odd rows, bounds, and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import collocations, common, packing, queries, sort_means

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"
EXTRA = "cluster int, n long, a string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in any column, other lengths, non-finite numbers, ties, repeated rows, and clashing names."""
    path = str(tmp_path_factory.mktemp("odd"))
    r = random.Random(5)
    some = [[r.gauss(0, 1) for _ in range(64)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(some)] + [(i + 100, some[i % 3]) for i in range(30)] + [(7, some[8]), (7, some[8]), (None, some[9]), (None, some[9])]
    rows += [(200, None), (201, []), (202, some[0][:63]), (203, some[0] + [0.0]), (204, [None, *some[0][1:]]), (205, [float("nan"), *some[0][1:]]), (206, [float("-inf"), *some[0][1:]])]
    rows += [(300, [0.0] * 64), (301, [-0.001] * 64), (302, [1000.0] * 64), (303, [-1000.0] * 64)]
    spark.createDataFrame([(*x, 3, None, "n") for x in rows], f"vec_id long, embedding array<float>, {EXTRA}").write.parquet(f"{path}/embeddings.parquet")
    phrase = "New York city hall, "
    texts = [(1, phrase * 130, "en"), (2, "NEW\tyork\x0bcity hall", None), (3, None, "en"), (4, "", "en"), (None, "a a a a a a a " * 40, "de"), (5, "a b a b a c! " * 60, None), (5, "a b a b a c! " * 60, "und"), (6, "x\x00y \xa0 é É " * 120, "fr"), (7, "w" * 3000 + " end", "de"), (8, "city hall; new york " * 120, "en")]
    spark.createDataFrame([(*x, 3, None, "n") for x in texts], f"doc_id long, text string, lang string, {EXTRA}").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_sort_means", "op12_packing", "op13_collocations"])
def test_empty_tables(spark, empty, odd, name):
    got = queries.queries()[name](spark, empty)
    assert got.collect() == []
    assert got.columns == queries.queries()[name](spark, odd).columns


def by_sql(name, path):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        files = f"{path}/{t}.parquet" + "/*.parquet" * Path(path, f"{t}.parquet").is_dir()
        con.sql(f"create view {t} as select * from '{files}'")
    got = con.sql(queries.ORACLE[name])
    return Counter(map(str, got.project(", ".join(f'"{c}"' for c in sorted(got.columns))).fetchall()))


@pytest.mark.parametrize("name", ["op11_sort_means", "op13_collocations"])
@pytest.mark.parametrize("where", ["odd", SF])
def test_equal_to_sql(spark, odd, name, where):
    path = odd if where == "odd" else where
    got = queries.queries()[name](spark, path)
    assert Counter(str(tuple(r)) for r in got.select(*sorted(got.columns)).collect()) == by_sql(name, path)


# 11 clusters


def test_scans_stop_early_and_stay_exact():
    """Clusters that lie apart need few comparisons; ties go to the smaller number, also at exactly twice the distance."""
    r = np.random.default_rng(3)
    centroids = r.integers(-2000, 2000, (40, 64))
    v = centroids[r.integers(0, 40, 3000)] + r.integers(-20, 20, (3000, 64))
    best, dist, n = sort_means.Orders(centroids).assign(v, r.integers(0, 40, 3000))
    every = ((v[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (dist == every.min(1)).all()
    again, _, few = sort_means.Orders(centroids).assign(v, best)
    assert (again == best).all() and few < 1.1 * len(v) < n
    line = np.array([[4], [0], [0], [8]])
    got, d, _ = sort_means.Orders(line).assign(np.array([[2], [6], [4], [0]]), np.array([1, 3, 3, 2]))
    assert got.tolist() == [0, 0, 0, 1] and d.tolist() == [4, 4, 0, 0]


def test_large_components_are_refused(spark):
    big = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        sort_means.integers(big).collect()


# 12 packing


def check_packing(rows, docs, capacity=4096):
    """Places are gapless, nothing is too long, and pieces are the documents' own. Returns the number of sequences."""
    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for key, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            want[(key, n, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values(), default=0) <= capacity
    return len(filled)


@pytest.mark.parametrize("where", ["odd", SF])
def test_packing(spark, odd, where):
    path = odd if where == "odd" else where
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = queries.op12_packing(spark, path).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    least = max(-(-sum(r.length for r in rows) // 4096), sum(r.length > 2048 for r in rows))
    assert least <= used <= least + 1


def test_packing_in_many_groups(spark):
    """Groups of some 200 pieces: what they leave open is packed again, and few sequences are wasted."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(packing.pieces(docs, TOKENIZER), group=200).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert used <= 1.03 * sum(r.length for r in rows) / 4096 + 1


def test_packing_of_what_never_closes(spark):
    parts = spark.range(500).select("id", F.lit(3000).cast("long").alias("length"))
    rows = packing.pack(parts, group=20).collect()
    assert len({r.sequence_id for r in rows}) == 500 and {r.offset for r in rows} == {0}


def test_place_follows_the_sum_of_squares():
    r = random.Random(2)
    lengths, capacity = [r.randint(1, 20) for _ in range(300)], 20
    where, offset, gaps = packing.place(np.array(lengths), capacity)
    open_ = {}
    for s, b, o in zip(lengths, where.tolist(), offset.tolist()):
        count = Counter(g for g in open_.values() if 0 < g < capacity)

        def total(g):
            after = count.copy()
            if g < capacity:
                after[g] -= 1
            if 0 < g - s < capacity:
                after[g - s] += 1
            return sum(x * x for x in after.values())

        assert total(open_.get(b, capacity)) == min(total(g) for g in {*count, capacity} if g >= s)
        assert o == capacity - open_.get(b, capacity)
        open_[b] = open_.get(b, capacity) - s
    assert [open_[b] for b in range(len(gaps))] == gaps.tolist()


def test_encoder_forgets_and_marks(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 50)
    t = Tokenizer.from_file(TOKENIZER)
    encoder = packing.Encoder(open(TOKENIZER, "rb").read())
    r = random.Random(1)
    parts = ["<|endoftext|>", "<|startoftext|>x", "it's", "a\x1cb", "́e", "é", "é", "\x85", " ", "ΣΑΣ", "İ", "<|", "|>", "12345", "don't!!", "ﬀ", "　", "word</w>"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(600)] + [None]
    for i in range(0, len(texts), 40):
        for text, raw in zip(texts[i : i + 40], encoder.encode(texts[i : i + 40]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids
    assert len(encoder.known) < 50 + 40 * 12 * 5


# 13 phrases


def brute(texts, least, longest):
    """Counts of all phrases by language, and words."""
    count, words = Counter(), Counter()
    for lang, text in texts:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                count.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return {p: n for p, n in count.items() if n >= least}, {k: v for k, v in words.items() if v}


def random_texts(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "the", "of", "é", "x\x00", *(f"w{i}" for i in range(30))]
    return [(r.choice(["en", "de", None]), "".join(r.choices(vocabulary, [2.0 ** -min(i, 8) for i in range(len(vocabulary))])[0] + r.choice([" ", " ", "  ", "\t", " ", ", ", ".\n"]) for _ in range(r.randint(0, 200)))) for _ in range(60)]


@pytest.mark.parametrize(("share", "slots", "entries", "window"), [(1 << 17, 1 << 20, 300_000, 200_000), (40, 1 << 20, 300_000, 50), (10, 8, 20, 7)])
def test_frequent_phrases(spark, monkeypatch, tmp_path, share, slots, entries, window):
    """Counts equal brute force with hot pivots in many groups, a table of counts full of collisions, and full memories."""
    for name, value in (("SHARE", share), ("SLOTS", slots), ("ENTRIES", entries), ("WINDOW", window)):
        monkeypatch.setattr(collocations, name, value)  # tasks get them with their functions
    texts = random_texts(share)
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    phrases, sizes = collocations.frequent(docs, common.Store(spark, "test"), 12, 5)
    want, words = brute(texts, 12, 5)
    assert {(r.lang, r.phrase): r.a for r in phrases.collect()} == want
    assert {r.lang: r.n for r in sizes.collect()} == words
    assert all(r.k == r.phrase.count(" ") + 1 for r in phrases.collect())


def test_tokens_of_long_texts(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 16)
    text = "One two;three " + "x" * 100 + " End\ttail. " + "y" * 40
    got = [w for part in collocations.tokens(text) for w in part]
    assert got == [b"\xff", b"one", b"two", b"\xff", b"three", b"x" * 100, b"end", b"tail", b"\xff", b"y" * 40]
    assert len(list(collocations.tokens(text))) == 4


def test_a_phrase_is_owned_once():
    """Every occurrence of every phrase is in the fragment of exactly one place."""
    r = np.random.default_rng(0)
    rarity = r.integers(-1, 6, 2000)
    left, right = collocations.reach(rarity, 5)
    for i in range(2000 - 5):
        for k in range(2, 6):
            owners = [p for p in range(i, i + k) if left[p] >= 0 and p - left[p] <= i and p + right[p] >= i + k - 1]
            assert len(owners) == (0 if (rarity[i : i + k] < 0).any() else 1)


def test_sort_means_seed_order(spark, odd):
    rows = spark.read.parquet(f"{odd}/embeddings.parquet")
    kept = sort_means.integers(rows)
    first = sort_means.first_centroids(kept, 40)
    hashed = sorted((hashlib.sha256(f"2:{'null' if r.vec_id is None else r.vec_id}".encode()).hexdigest(), list(r.v)) for r in kept.collect())
    assert first.tolist() == [v for _, v in hashed[:40]]
