"""Operators for training data: brute force, round trips, held-out rows, and odd inputs."""

import gzip
import hashlib
import math
import io
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import bpe, common, decontam, html_density, learning, matroska, neardup, quality, queries, sharding, suffix_dedup, toxicity, warc

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, ids string, shard string, ranges string, tid string, n string"
LONG = " ".join(f"word{i} is long" for i in range(40_000))


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rest = ("x", None, 1, 0.5, "n", "i", "s", "r", "t", "n")
    texts = [(None, None), (None, "a row without id"), (1, None), (2, ""), (3, " \n\t"), (4, "short"), (5, LONG), (6, "same text of some words here"), (6, "same text of some words here"), (7, "same text of some words here"), (8, "é" * 700), (9, "é" * 700 + "tail"), (10, "\x00\x1c control <|endoftext|> tail")]
    return [(i, t, *rest) for i, t in texts] + [(11, "nulls elsewhere", *[None] * 10)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (None, 1, 1, "x"), (5, None, None, "x"), (6, 1, 1, "x"), (7, 0, 0, "x")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, "Short ITEM"), (0, "Short ITEM"), (1, None), (2, ""), (3, "word7 is long word8 is long word9 is long word10 is long word11 is"), (None, "same text")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    page = "<html><body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>Text &amp; more</article></body></html>"
    spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (None, "u", "", None), (3, "u é\n", "y" * 2000, "t"), (4, "u", "y" * 2000, "t"), (4, "u", "y" * 2000, "t"), (5, "u", "<" * 500, "t")], "page_id long, url string, html string, text string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


#: Queries with one row for each row of their table; the others are tested in test_clusters_packing_phrases.py.
BY_ROW = sorted(n for n in queries.queries() if int(n[2:].split("_")[0]) <= 10)


@pytest.mark.parametrize("name", BY_ROW)
def test_odd_rows(spark, odd, name):
    rows = queries.queries()[name](spark, odd).collect()
    pages = name in ("op1_warc", "op3_html_text")
    assert len(rows) == (7 if pages else len(odd_rows()))
    key = "page_id" if pages else "doc_id"
    want = Counter([1, 2, None, 3, 4, 4, 5] if pages else [r[0] for r in odd_rows()])
    assert Counter(r[key] for r in rows) == want


@pytest.mark.parametrize("name", BY_ROW)
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


def test_pipeline_odd_and_empty(spark, odd, empty):
    docs = {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()}
    assert {1, 2, 3, 4, 5} <= docs and 7 not in docs
    assert corpus_pipeline.run(spark, empty).count() == 0


# 1 WARC


def test_warc_results(spark, odd):
    rows = queries.op1_warc(spark, odd).collect()
    big = sorted((r.page_id, r.record_type, r.refers_to) for r in rows if r.payload_bytes == 2000)
    assert big == [(3, "revisit", 4), (4, "response", None), (4, "response", None)]
    assert all(r.payload_digest == hashlib.sha1(b"").hexdigest() for r in rows if r.payload_bytes == 0)


def test_warc_frames():
    payload = bytes(range(256)) * 2000
    body = warc.page_record(1, "http://x/a b", payload, None, False) + warc.page_record(2, None, payload, 1, True) + warc.page_record(None, "u", b"", None, False)
    got = list(warc.read_records(io.BytesIO(body), payloads=True))
    assert [r["record_type"] for r in got] == ["response", "revisit", "response"]
    assert got[0]["payload"] == payload and got[1]["payload"] == b"" and got[1]["payload_bytes"] == len(payload)
    assert got[1]["refers_to"] == 1 and got[2]["key"] is None
    assert body[got[1]["offset"] : got[1]["offset"] + got[1]["length"]] == warc.page_record(2, None, payload, 1, True)
    assert gzip.decompress(body).count(b"WARC/1.1") == 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(body[:-20])))
    raw = gzip.decompress(warc.page_record(1, "u", b"abc", None, False))
    for bad in (raw.replace(b"abc", b"abd"), raw.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))


# 2 BPE


def test_bpe_equals_the_library(spark, odd):
    t = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{odd}/documents.parquet").unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    got = bpe.digests(docs, TOKENIZER, with_ids=True).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
        want[(r.doc_id, len(ids), *sha)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_bpe_remembers_a_bounded_number_of_characters(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 500)
    v = bpe.Vocabulary(__import__("json").load(open(TOKENIZER)))
    t = Tokenizer.from_file(TOKENIZER)
    r = random.Random(2)
    for i in range(60):
        text = " ".join("".join(r.choice("abcdefgh0123456789+/") for _ in range(r.choice([3, 8, 900, 5000]))) for _ in range(12))
        assert v.encode(text) == t.encode(text, add_special_tokens=False).ids
        for seen in (v.seen_chunks, v.seen_words):
            held = [*seen.new, *seen.old]
            assert sum(map(len, held)) <= 2 * (500 * bpe.MEAN + bpe.LONGEST) and max(map(len, held), default=0) <= bpe.LONGEST


def test_bpe_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "Don't STOP, ﬁne"), (2, None)], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER).orderBy("doc_id").collect()
    t = Tokenizer.from_file(TOKENIZER)
    assert rows[0].decoded == t.decode(rows[0].ids, skip_special_tokens=False) and rows[1].ids == [] and rows[1].decoded == ""


# 3 HTML


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>A &lt; B</h1><p>one<br>two<p>three</article><footer>f</footer>", "A < B\none two\nthree"),
        ("<body><div class='sidebar'><p>side side side side side side</p></div><div class='content'><p>The text, which is long enough.</p><p>More &nbsp; of it.</p></div><section id='comments'><p>I disagree with everything.</p></section></body>", "The text, which is long enough.\nMore of it."),
        ("<body class='has-sidebar'><p>kept</p><script>var a='<p>no</p>'</script><form><p>no</p></form></body>", "kept"),
        ("", ""),
        (None, ""),
        ("plain text", "plain text"),
        ("<p>never <b>closed", "never closed"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<article><p>x < y and <3</p></article>", "x < y and <3"),
    ],
)
def test_html(page, want):
    assert html_density.extract(page) == want


@pytest.mark.parametrize("begin, end", [("<article>", "</article>"), ("<div>", "</div>"), ('<div class="widget Blog">', "</div>"), ('<div class="newsletter-article">', "</div>"), ('<div id="promo"><section>', "</section></div>"), ('<div class="sidebar-left"><article>', "</article></div>"), ("<div class=share><div class=ad-wide><main>", "</main></div></div>")])
def test_html_pages(begin, end):
    """Whatever the element around the main text is and calls itself."""
    import html
    import re

    pages = duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()
    for _, h in pages:
        body = h[h.index("<article>") + 9 : h.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert html_density.extract(h.replace("<article>", begin).replace("</article>", end)) == "\n".join(b for b in blocks if b)


_LINE = "A sentence of the text that is long enough to count as text, and has no links at all in it. "


@pytest.mark.parametrize(
    "page, want",
    [
        # sections of one article, with text between them and a few links
        (f"<article><h1>Head</h1>First words.<section><p>{_LINE * 3}</p><p>{_LINE}</p></section><section><p>{_LINE * 2}</p><p><a href=x>A source</a></p></section></article>", ["Head", "First words.", _LINE * 3, _LINE, _LINE * 2, "A source"]),
        # without article: paragraphs of two containers, and a list of links beside them
        (f"<div><div><h2>Head</h2><p>{_LINE * 3}</p><p>{_LINE * 2}</p></div><div><p>{_LINE * 2}</p></div><div><ul>{'<li><a href=x>A link to another page</a></li>' * 8}</ul></div></div>", ["Head", _LINE * 3, _LINE * 2, _LINE * 2]),
        # comments that are longer than the article, and an advert that is
        (f"<div class=post><h1>Head</h1><p>{_LINE}</p></div><div class=comments>{f'<p>{_LINE * 3}</p>' * 9}</div>", ["Head", _LINE]),
        (f"<article><p>Short.</p></article><div class=advert><p>{_LINE * 9}</p></div>", ["Short."]),
        # a wrapper that is called a widget, and has widgets in it
        (f"<div class='widget'><h1>Head</h1><p>{_LINE * 5}</p><div class='widget share'><p>Tell your friends</p></div><div id=comments><p>{_LINE}</p></div></div><div class=widget><p>Side</p></div>", ["Head", _LINE * 5]),
        # comments alone
        (f"<div class=comments><p>{_LINE}</p></div>", [_LINE]),
    ],
)
def test_html_by_density(page, want):
    assert html_density.extract(f"<html><body>{page}</body></html>") == "\n".join(x.strip() for x in want)


# 4 Near duplicates


def brute_components(docs, k):
    """doc_id: (set size, component) over (doc_id, text), by all pairs."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    posting = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posting[g].append(i)
    shared = Counter()
    for ids in posting.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, block, most", [(4, 512, 1 << 28), (5, 512, 1 << 28), (4, 3, 1 << 28), (5, 2, 128)])
def test_near_duplicates(spark, monkeypatch, k, block, most):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FILTER_MOST", most)
    r = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(1, ""), (2, None), (3, "Two Words"), (4, "two  words"), (5, "three other words")]
    for base in range(12):
        words = [r.choice(vocabulary) for _ in range(r.choice([6, 20, 60, 200]))]
        for copy in range(r.choice([2, 5, 30])):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 2, len(w) // 25, len(w) // 12])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append((100 + len(docs), " ".join(w)))
    want = brute_components(docs, k)
    got = neardup.components(spark.createDataFrame(docs, "doc_id long, text string"), k).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    assert len({c for _, c in want.values()}) < len(docs)


def test_blocks_give_the_same(spark, monkeypatch):
    r = random.Random(1)
    words = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*words[: 90 - i % 3], *[r.choice(words) for _ in range(8)]])) for i in range(60)]
    want = brute_components(docs, 4)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = neardup.components(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_chains_beyond_the_hub(spark, monkeypatch):
    """Texts that slide along a long one: each is linked with its neighbours only, of which the hub reaches few."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[3 * i : 3 * i + 60 + i % 5])) for i in range(60)] + [(100 + i, " ".join(words[::-1][: 40 + 3 * i])) for i in range(40)]
    random.Random(0).shuffle(docs)
    want = brute_components(docs, 4)
    got = neardup.components(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert len({c for _, c in want.values()}) < 10


def test_sizes_of_similar_sets_are_near():
    n = np.arange(1, 3000)
    near = np.floor(np.log(n) / np.log(100 / neardup.SIMILAR) + 1e-9).astype(int)
    for i in range(len(n)):
        j = np.flatnonzero(100 * np.minimum(n[i], n) >= neardup.SIMILAR * np.maximum(n[i], n))
        assert np.abs(near[j] - near[i]).max() <= 1


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 63, 400).astype(np.uint64), r.integers(0, 1 << 63, 300).astype(np.uint64)
    assert (neardup.registers(np.concatenate([a, b])) == neardup.merge(neardup.registers(a), neardup.registers(b))).all()

    def likely(share):
        n = 600
        hits = 0
        for _ in range(40):
            x = r.integers(0, 1 << 63, n).astype(np.uint64)
            y = np.concatenate([x[: int(n * 2 * share / (1 + share))], r.integers(0, 1 << 63, n - int(n * 2 * share / (1 + share))).astype(np.uint64)])
            sx, sy = neardup.registers(x), neardup.registers(y)
            hits += bool(neardup.at_least(np.array([n]), np.array([n]), np.array([(sx > sy).sum()]), np.array([(sx < sy).sum()]), neardup.ESTIMATE)[0])
        return hits / 40

    assert likely(0.8) == 1.0 and likely(0.3) == 0.0


def test_estimate_keeps_similar_pairs():
    """Bands and the estimate's cut together lose a pair of 80 % with a probability below 1e-7, whatever the sizes."""
    m = neardup.REGISTERS
    larger, smaller = (x.reshape(-1) for x in np.meshgrid(np.arange(m + 1), np.arange(m + 1)))
    larger, smaller = larger[larger + smaller <= m], smaller[larger + smaller <= m]
    ways = np.array([math.lgamma(i + 1) for i in range(m + 1)])
    for share in (1.0, 0.97, 0.95, 0.9, 0.85):
        u, v = share / (1 + share), 1 / (1 + share)
        c = (neardup.BASE - 1) / neardup.BASE
        p, q = (-math.log(1 - x * c) / math.log(neardup.BASE) for x in (u - 0.8 * v, v - 0.8 * u))
        log = ways[m] - ways[larger] - ways[smaller] - ways[m - larger - smaller] + larger * math.log(p) + smaller * math.log(q) + (m - larger - smaller) * math.log(1 - p - q)
        kept = neardup.at_least(np.full(len(larger), 1000 * share), np.full(len(larger), 1000.0), larger, smaller, neardup.ESTIMATE)
        assert (1 - 0.8**neardup.ROWS) ** (m // neardup.ROWS) + np.exp(log)[~kept].sum() < 1e-7, share


# 5 and 10: trained operators


@pytest.mark.parametrize("name, label, module", [("op5_quality", "quality", quality), ("op10_toxicity", "toxic", toxicity)])
def test_held_out(spark, name, label, module):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.train(learning.sample(docs, labels, label, per_class=400))
    held = docs.join(labels.select("doc_id", label), "doc_id").filter(~common.training_row("doc_id")).select("doc_id", "text", label).filter("doc_id % 2 = 0")
    rows = module.score(held, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) > 100
    order = sorted(rows, key=lambda r: r.score)
    ones = [i for i, r in enumerate(order) if r[label] == 1]
    n1, n0 = len(ones), len(rows) - len(ones)
    area = (sum(ones) - n1 * (n1 - 1) / 2) / (n1 * n0)
    assert area > 0.9, area


def test_folds(spark):
    d = spark.createDataFrame([(i,) for i in (0, 1, 12, 12345)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in d.select("doc_id", common.training_row("doc_id")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in (0, 1, 12, 12345)}
    assert [common.held_out(i) for i in (0, 1, None)] == [not got[0], not got[1], False]


def test_scores_depend_on_the_text_alone():
    rows = [("a bad idiot word here " * 3, 1), ("a fine nice word here " * 3, 0)] * 30
    net = toxicity.train(rows)
    s = toxicity.Scorer(net)
    one = s.scores(["you idiot", "a nice day", None, ""])
    assert one[0] > 0.5 > one[1] and one[2] == one[3] == 0.0
    assert s.scores(["a nice day"] * 3 + ["you idiot"]) == pytest.approx([one[1]] * 3 + [one[0]], abs=1e-5)
    assert toxicity.Scorer(toxicity.train([])).scores(["x"]) == [0.0] and quality.train([]).scores(["x"]) == [0.5]
    m = quality.train([("plain words here " * 30, 1), ("JUNK!! JUNK!! " * 30, 0)] * 20)
    good, bad = m.scores(["plain words here " * 50, "JUNK!! JUNK!! " * 50])
    assert good > 0.5 > bad


def test_windows():
    assert toxicity.starts_of(10) == [0] and toxicity.starts_of(20) == [0] and toxicity.starts_of(21) == [0, 1] and toxicity.starts_of(45) == [0, 10, 20, 25]


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 40)
    for n in (0, 1, 19, 20, 40, 41, 50, 60, 61, 79, 80, 81, 187, 201):
        words = [b"%d" % i for i in range(n)]
        got = {tuple(p[s : s + toxicity.LENGTH]) for p in toxicity.pieces(words) for s in toxicity.starts_of(len(p))}
        want = {tuple(words[s : s + toxicity.LENGTH]) for s in toxicity.starts_of(n)} if n else set()
        assert want <= got, n
        assert len(got) <= len(want) + n // 40


def test_every_length_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 40)
    for n in range(331):
        words = [b"%d" % i for i in range(n)]
        got = Counter(tuple(p[s : s + toxicity.LENGTH]) for p in toxicity.pieces(words) for s in range(max(len(p) - toxicity.LENGTH, 0) + 1))
        assert got == Counter(tuple(words[s : s + toxicity.LENGTH]) for s in range(max(n - toxicity.LENGTH, 0) + 1) if n), n


def test_windows_begin_at_every_word(monkeypatch):
    net = toxicity.train([("a bad idiot word here " * 3, 1), ("a fine nice word here " * 3, 0)] * 30)
    monkeypatch.setattr(toxicity, "PART", 40)
    monkeypatch.setattr(toxicity, "AT_ONCE", 50)
    r = random.Random(3)
    texts = [[r.choice("a bad idiot fine nice word here you".split()) for _ in range(n)] for n in (1, 19, 20, 21, 33, 40, 59, 60, 200)]
    for words, got in zip(texts, toxicity.Scorer(net).scores([" ".join(w) for w in texts])):
        words = [w.encode() for w in words]
        different = sorted(set(words))
        x = np.array([different.index(w) for w in words])
        gates = net.project(net.vectors(toxicity.grams(different)))
        logits = [net.run(gates, x[None, a : a + toxicity.LENGTH], None)[0] for a in range(max(len(x) - toxicity.LENGTH, 0) + 1)]
        assert got == pytest.approx(float(learning.sigmoid(net.slope * max(logits) + net.shift)), abs=1e-5), len(words)


def test_remembered_words_have_room_for_the_longest_piece(monkeypatch):
    net = toxicity.train([("a bad idiot word here " * 3, 1), ("a fine nice word here " * 3, 0)] * 30)
    texts = [" ".join(f"{x}{i}" for i in range(n)) for x, n in (("p", 40), ("q", 39), ("r", 59))]
    want = toxicity.Scorer(net).scores(texts)
    monkeypatch.setattr(toxicity, "PART", 40)
    monkeypatch.setattr(toxicity, "MEMORY", 120)
    assert toxicity.Scorer(net).scores(texts) == pytest.approx(want, abs=1e-5)


# 6 Suffix arrays


def brute_repeats(docs):
    count = Counter()
    for _, t in docs:
        d = (t or "").encode()
        count.update(d[i : i + 400] for i in range(len(d) - 399))
    out = Counter()
    for k, t in docs:
        d = (t or "").encode()
        cut = bytearray(len(d))
        for i in range(len(d) - 399):
            if count[d[i : i + 400]] > 1:
                cut[i : i + 400] = b"\x01" * 400
        runs = sum(1 for i in range(len(cut)) if cut[i] and (not i or not cut[i - 1]))
        out[(k, len(d), sum(cut), runs, hashlib.sha256(bytes(b for b, c in zip(d, cut) if not c)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("group", [4000, 1])
def test_repeats(spark, monkeypatch, group):
    r = random.Random(group)
    base = "".join(r.choice("abcdefgh ij") for _ in range(3000))
    docs = [(None, None), (1, ""), (2, "x" * 2000), (3, base), (4, base[500:1400] + "zz" + base), (5, base[:399]), (6, base[100:500]), (6, base[100:500]), (7, "é" * 900), (8, "ab" * 700), (9, base[1000:] + base[:1200]), (10, "q" + base[700:1150] + "r"), (11, base[300:699])]
    docs += [(20 + i, "".join(r.choice("klmnop") for _ in range(200)) + base[2000:2450] + "".join(r.choice("klmnop") for _ in range(200))) for i in range(15)]
    docs += [(50 + i, base[:1500] + str(i) + base[1500:]) for i in range(5)]
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in got) == brute_repeats(docs)


def test_repeats_on_the_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF.replace('0.01', '0.001')}/documents.parquet'").fetchall()
    got = queries.op6_suffix_array(spark, SF.replace("0.01", "0.001")).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute_repeats(docs)


def brute_word_repeats(docs, window):
    """doc_id: words that no repeated run of `window` words covers."""
    words = [(k, (t or "").split()) for k, t in docs]
    count = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in words:
        cut = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                cut.update(range(i, i + window))
        out.append((k, tuple(x for i, x in enumerate(w) if i not in cut)))
    return Counter(out)


@pytest.mark.parametrize("group, window", [(4000, 51), (1, 51), (4000, 9), (4000, 3)])
def test_repeated_words(spark, monkeypatch, group, window):
    r = random.Random(window)
    make = lambda n: [r.choice(["été", "bb", "c", "dd", "e"]) + str(r.randrange(40)) for _ in range(n)]
    passage = make(60)
    docs = [(None, None), (1, ""), (2, "x " * 300), (3, " ".join(passage[:50])), (4, " ".join(passage[:51])), (5, " ".join(passage[5:56])), (6, " ".join(make(70))), (6, "one row\ntwice " * 40), (6, "one row\ntwice " * 40)]
    docs += [(10 + i, "\n".join(make(20)) + "\t" + r.choice([" ", "\n", "  "]).join(passage[i % 3 :]) + "\n" + " ".join(make(30))) for i in range(20)]
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(frame, unit=suffix_dedup.by_words(window)).collect()
    assert Counter((x.doc_id, tuple((x.text or "").split())) for x in got) == brute_word_repeats(docs, window)
    lost = {x.doc_id: x.n_bytes - x.n_removed for x in suffix_dedup.scan(frame.filter("doc_id >= 10"), unit=suffix_dedup.by_words(window)).collect()}
    kept = {x.doc_id: len(x.text.encode()) for x in suffix_dedup.remove_repeats(frame.filter("doc_id >= 10"), unit=suffix_dedup.by_words(window)).collect()}
    assert lost == kept


def test_suffix_arrays():
    r = random.Random(3)
    for _ in range(200):
        x = [r.randrange(r.choice([1, 2, 3, 900])) for _ in range(r.randint(0, 60))] * r.choice([1, 1, 3])
        assert suffix_dedup.suffix_order(x, 900) == sorted(range(len(x)), key=lambda i: x[i:])
    for _ in range(600):
        x = bytes(r.randrange(r.choice([1, 2, 3, 26])) for _ in range(r.randint(0, 60))) * r.choice([1, 1, 3])
        assert suffix_dedup.suffix_order(x) == sorted(range(len(x)), key=lambda i: x[i:])


# 7 Matroska


def test_matroska_round_trip(spark):
    for n in (0, 1, 575, 576, 577, 200_000):
        data, size = matroska.mux_text("é" * n)
        m = matroska.parse(data)
        assert size == 2 * n and matroska.payload(data, m) == matroska.padded("é" * n)[0]
        assert [p.timestamp for p in m.packets] == [72 * i for i in range(len(m.packets))]
        assert [c[2] for c in m.cues] == m.clusters and m.tracks[1]["bits"] == 8
    docs = spark.createDataFrame([(1, "a" * 2000), (2, None)], "doc_id long, text string")
    rows = matroska.packets(matroska.mux_texts(docs), "doc_id").collect()
    assert Counter(r.doc_id for r in rows) == {1: 4, 2: 1} and {r.size for r in rows} == {576}


def test_matroska_forms():
    frames = [bytes([i]) * n for i, n in enumerate((3, 300, 7, 7, 600))]
    for kind in (0, 1, 3):
        group = frames if kind else frames[:1]
        block = b"\x81\x00\x05" + bytes([0x80 | kind << 1]) + matroska._lacing(group, kind) + b"".join(group)
        cluster = (matroska.CLUSTER).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska._number(matroska.TIMESTAMP, 100) + matroska._element(matroska.SIMPLE_BLOCK, block) + matroska._element(matroska.VOID, b"..")
        late = matroska._element(matroska.CLUSTER, matroska._number(matroska.TIMESTAMP, 900) + matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, b"\x81\x00\x00\x00zz") + matroska._element(matroska.REFERENCE, b"\x01")))
        data = matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + late
        m = matroska.parse(data)
        assert [data[p.offset : p.offset + p.size] for p in m.packets] == [*group, b"zz"]
        assert m.packets[0].timestamp == 105 and m.packets[-1].timestamp == 900 and not m.packets[-1].keyframe
    with pytest.raises(matroska.MatroskaError):
        matroska.parse(matroska.mux_text("abc")[0][:-3])


def test_damaged_matroska(spark):
    """Whatever is changed in a file, it is parsed or raises MatroskaError, and the packet table goes on."""
    r = random.Random(11)
    whole = matroska.mux_text("some text " * 900)[0]
    files, broken = [], 0
    for i in range(3000):
        data = bytearray(whole)
        for _ in range(r.choice([1, 1, 2, 5])):
            at = r.randrange(r.choice([60, 400, len(data)]))
            if r.random() < 0.2:
                del data[at : at + r.randrange(1, 9)]
            else:
                data[at] = r.choice([0, 1, 127, 128, 255, r.randrange(256)])
        try:
            matroska.parse(bytes(data))
        except matroska.MatroskaError:
            broken += 1
        if i < 300:
            files.append((i, bytes(data)))
    assert 100 < broken < 3000
    rows = matroska.packets(spark.createDataFrame([*files, (300, None), (301, b""), (302, b"plain"), (303, whole)], "k int, media binary"), "k").collect()
    for i, data in [*files, (302, b"plain"), (303, whole)]:
        mine = [x for x in rows if x.k == i]
        try:
            n = len(matroska.parse(data).packets)
        except matroska.MatroskaError as e:
            assert [(x.packet, x.error) for x in mine] == [(None, str(e))]
        else:
            assert [x.packet for x in sorted(mine, key=lambda x: x.packet or 0)] == list(range(n)) or [x.error for x in mine if x.error]
    assert not [x for x in rows if x.k in (300, 301)]


@pytest.mark.parametrize("name", ["op7_matroska"])
def test_media_digests_by_brute_force(spark, odd, name):
    """Every column, from the stored form's own bytes by a reader that only knows where samples lie."""
    for sf in (odd, SF.replace("0.01", "0.001")):
        texts = Counter((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
        want = Counter()
        for (i, t), n in texts.items():
            raw = (t or "").encode()
            data = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
            file = matroska.mux_text(t)[0]
            x = list(data)
            mean = sum(x) / len(x)
            spread = max(0.0, sum(v * v for v in x) / len(x) - mean * mean) ** 0.5
            turns = sum((a > 127) != (b > 127) for a, b in zip(x, x[1:]))
            packets = len(data) // 576
            text = f"packets={packets};clusters={-(-packets // 128)};cues={-(-packets // 128)};seconds={packets * 0.072:.3f};mean={mean:.6f};deviation={spread:.6f};turns={turns}"
            want[(i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file), hashlib.sha256(file).hexdigest(), text)] += n
        got = Counter(tuple(r) for r in queries.queries()[name](spark, sf).collect())
        assert got == want


# 8 Decontamination


def test_decontamination_parts(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {r.doc_id: (r.n_words, r.n_hit, tuple(r.item_ids), str(r.hit_spans)) for r in decontam.scan(docs, bench).collect()}
    many = {r.doc_id: (r.n_words, r.n_hit, tuple(r.item_ids), str(r.hit_spans)) for r in decontam.scan(docs, bench, slice_bytes=1500).collect()}
    assert one == many and sum(v[1] > 0 for v in one.values()) > 5
    kept = {r.doc_id for r in decontam.remove_documents(docs, bench).select("doc_id").collect()}
    assert kept == {k for k, v in one.items() if not (v[1] and 20 * v[1] >= v[0])}
    assert kept == {r.doc_id for r in decontam.remove_documents(docs, bench, slice_bytes=1500).select("doc_id").collect()}


def test_decontamination_spans(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, "Before, ONE-two three four five six seven eight nine ten eleven twelve thirteen; after"), (2, "tiny item!"), (3, None), (4, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "Tiny ITEM")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.scan(docs, bench).collect()}
    assert got == {1: (15, 13, ["7"]), 2: (2, 2, ["8"]), 3: (0, 0, []), 4: (2, 0, [])}
    texts = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()}
    assert texts == {1: "Before, ; after", 2: "!", 3: None, 4: "one two"}


@pytest.mark.parametrize("slice_bytes", [1 << 20, 100])
def test_decontamination_by_items_without_an_id(spark, slice_bytes):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[20:])), (3, "clean " * 20)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(words[2:15])), (None, "w0 w0"), (7, " ".join(words[5:18])), (None, " ".join(words[20:33]))], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids, r.hit_spans) for r in decontam.scan(docs, bench, slice_bytes=slice_bytes).collect()}
    assert got == {1: (16, ["7"], [[2, 18]]), 2: (13, [], [[0, 13]]), 3: (0, [], [])}
    assert [r.doc_id for r in decontam.remove_documents(docs, bench, slice_bytes=slice_bytes).collect()] == [3]
    texts = {r.doc_id: r.text.split() for r in decontam.remove_spans(docs, bench, slice_bytes=slice_bytes).collect()}
    assert texts[2] == words[33:]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 100])
def test_decontamination_judges_rows_not_keys(spark, slice_bytes):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, "a"), (1, "clean", "b"), (None, words, "c"), (None, "clean", "d"), (2, None, "e"), (2, None, "e")], "doc_id long, text string, row_of string")
    bench = spark.createDataFrame([(1, words), (2, " ".join(f"v{i}" for i in range(30)))], "item_id long, text string")
    assert sorted(r.row_of for r in decontam.remove_documents(docs, bench, slice_bytes=slice_bytes).collect()) == ["b", "d", "e", "e"]
    assert sorted((r.row_of, r.text or "") for r in decontam.remove_spans(docs, bench, slice_bytes=slice_bytes).collect()) == [("a", ""), ("b", "clean"), ("c", ""), ("d", "clean"), ("e", ""), ("e", "")]
    assert sorted((str(r.doc_id), r.n_hit) for r in decontam.scan(docs, bench, slice_bytes=slice_bytes).collect()) == [("1", 0), ("1", 30), ("2", 0), ("2", 0), ("None", 0), ("None", 30)]


def test_windows_take_bounded_memory(monkeypatch):
    r = random.Random(5)
    short, long = (" ".join(f"{r.randrange(d)}" for _ in range(50_000)) for d in (9, 1_000_000))
    for text in (short, long):
        w = decontam.Windows([("x", text), (None, text[:20_000])])
        held = len(w.buffer) + sum(a.nbytes for a in [w.offset, w.known, *(a for x in w.sizes.values() for a in x)])
        assert held <= sum(decontam.cost(t.encode()) for t in (text, text[:20_000]))
    assert held < 10 * len(long)
    # windows that share a hash are told apart
    items = [("a", "one two three"), ("b", "two three four"), ("c", "one two three"), (None, "five six seven"), ("d", "x y")]
    monkeypatch.setattr(decontam.Windows, "rolled", staticmethod(lambda words, at, size: np.zeros(len(at), np.uint64)))
    w = decontam.Windows(items, 3)
    for text, hit, found in (("zero one two three", 3, {"a", "c"}), ("two three four", 3, {"b"}), ("five six seven x y", 5, {"d"}), ("three two one", 0, set())):
        got = w.hits(decontam.words_of(text))
        assert (int(got[0].sum()), got[1]) == (hit, found), text


# 9 Sharding


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op9_sharding(spark, SF).collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want
    load, places = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) <= 0.01 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards_by_brute_force(spark, odd):
    """Every column: slots by falling bytes to the lightest shard, records by slot and id."""
    for sf in (odd, SF):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        rows = []
        for i, t in docs:
            body = (t or "").encode()
            slot = int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:7], 16) % 4096
            rows.append((slot, (i is not None, i or 0, zlib.crc32(body), len(body) + 1), i, len(body) + 1, zlib.crc32(body)))
        held = Counter()
        for slot, _, _, size, _ in rows:
            held[slot] += size
        loads, to = [0] * 8, {}
        for slot in sorted(range(4096), key=lambda s: (-held[s], s)):
            best = loads.index(min(loads))
            to[slot] = best
            loads[best] += held[slot]
        place, want = Counter(), Counter()
        for slot, _, i, size, crc in sorted(rows, key=lambda r: (r[0], r[1])):
            shard = to[slot]
            want[(i, size, crc, "bytes", shard, place[shard], None, slot)] += 1
            place[shard] += 1
        got = queries.op9_sharding(spark, sf).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard, r.vslot) for r in got) == want


def test_rebalancing_moves_into_new_shards_only(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id"), F.octet_length("text").cast("long").alias("size"))
    totals = sharding.slot_totals(docs.withColumn("vslot", sharding.virtual_slot(F.col("doc_id"), 256)), 256)
    first = sharding.store_map(sharding.balanced_map(totals, 4), str(tmp_path / "map"), 1)
    second = sharding.store_map(sharding.rebalance(first, totals, 4, 5), str(tmp_path / "map"), 2)
    a, b = ({r.vslot: r.shard for r in m.collect()} for m in (first, second))
    assert set(a) == set(range(256)) and all(b[s] in (a[s], 4) for s in a)
    assert sharding.read_map(spark, str(tmp_path / "map")).first().version == 2
    load = Counter()
    for r in totals.collect():
        load[b[r.vslot]] += r.n_bytes
    assert load[4] > 0.1 * sum(load.values())


# The pipeline, stage by stage


def test_pipeline(spark):
    sf = SF.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        path = common.scratch(spark, "test-pipeline")
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        after[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == names
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    pairs = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    before, got = after["near_duplicates"]
    assert ids(got) == {i for i, (n, c) in brute_components(pairs(before), 5).items() if i == c or not n}
    before, got = after["repeated_passages"]
    want = brute_word_repeats(pairs(before), 51)
    assert Counter((i, tuple((t or "").split())) for i, t in pairs(got)) == want
    whole = Counter((i, tuple((t or "").split())) for i, t in pairs(before))
    assert sum((whole - want).values()) > 5
    assert all(r.n_chars == len(r.text) for r in got.collect())
    before, got = after["decontamination"]
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    w = decontam.Windows(bench)
    clean = {i for i, t in pairs(before) if not (lambda h, n: h and 20 * h >= n)(int(w.hits(decontam.words_of(t))[0].sum()), len(decontam.words_of(t)))}
    assert ids(got) == clean
    before, got = after["bpe"]
    t = Tokenizer.from_file(TOKENIZER)
    assert {r.doc_id: r.ids for r in got.collect()} == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in pairs(before)}
    before, got = after["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = ids(before) - ids(got)
    assert sum(labels.get(i, 1) for i in gone) >= 0.5 * len(gone) and sum(v == 0 and i in gone for i, v in labels.items()) <= 0.1 * len(labels)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    r = c.execute(queries.ORACLE[name])
    at = [[d[0] for d in r.description].index(x) for x in columns]
    assert Counter(tuple(x[i] for i in at) for x in r.fetchall()) == Counter(tuple(x[k] for k in columns) for x in got.collect())


def test_folder_is_shared(spark):
    assert Path(common.shared_folder(spark).removeprefix("file:")).exists()


def test_gradients_of_the_network():
    """Against differences of the loss, for windows with and without empty places."""
    r = np.random.default_rng(4)
    net = toxicity.Encoder(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("chars", "words")}
    x = r.standard_normal((7, toxicity.CHAR_DIM + toxicity.WORD_DIM))
    idx = r.integers(0, 7, (5, 6))
    valid = np.arange(6) < np.array([[6], [6], [3], [1], [5]])
    target = np.array([1.0, 0.0, 1.0, 0.0, 1.0])

    def loss():
        z = net.run(net.project(x), idx, valid)
        return float(np.sum(np.logaddexp(0, z) - target * z))

    def exact():
        gates = net.project(x)
        z, kept = net.run(gates, idx, valid, keep=True)
        g, d = net.gradients(gates, idx, valid, kept, learning.sigmoid(z) - target)
        return g | {"xf": x.T @ d[0], "cf": d[0].sum(axis=0), "xb": x.T @ d[1], "cb": d[1].sum(axis=0)}, d[0] @ net.p["xf"].T + d[1] @ net.p["xb"].T

    got, dx = exact()
    assert set(got) == set(net.p)
    for name, array in [*net.p.items(), ("x", x)]:
        g = dx if name == "x" else got[name]
        for _ in range(12):
            at = tuple(r.integers(0, s) for s in array.shape)
            was, step = array[at], 1e-3
            array[at] = was + step
            up = loss()
            array[at] = was - step
            down = loss()
            array[at] = was
            assert (up - down) / (2 * step) == pytest.approx(float(g[at]), abs=2e-3, rel=2e-2), (name, at)


def slow_logit(p, vectors):
    """The network's logit of one window, number by number."""
    n = toxicity.HIDDEN
    sigma = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda v, m, j: sum(float(a) * float(m[i][j]) for i, a in enumerate(v))
    states = [[0.0] * (2 * n) for _ in vectors]
    for side, order, at in (("f", range(len(vectors)), 0), ("b", range(len(vectors) - 1, -1, -1), n)):
        h = [0.0] * n
        for t in order:
            x, u, c = p["x" + side], p["h" + side], p["c" + side]
            gate = lambda j: dot(vectors[t], x, j) + float(c[j])  # noqa: B023, E731
            z = [sigma(gate(j) + dot(h, u, j)) for j in range(n)]
            rest = [sigma(gate(n + j) + dot(h, u, n + j)) for j in range(n)]
            new = [math.tanh(gate(2 * n + j) + rest[j] * dot(h, u, 2 * n + j)) for j in range(n)]
            h = [new[j] + z[j] * (h[j] - new[j]) for j in range(n)]
            states[t][at : at + n] = h
    s = [sum(math.tanh(dot(v, p["a"], j)) * float(p["s"][j]) for j in range(toxicity.ATTENTION)) for v in states]
    w = [math.exp(v - max(s)) for v in s]
    pooled = [sum(a * v[j] for a, v in zip(w, states)) / sum(w) for j in range(2 * n)]
    return sum(a * float(b) for a, b in zip(pooled, p["o"])) + float(p["b"][0])


def test_scores_by_a_slow_scorer(spark):
    """The query's scores on a few texts, from the trained network, every window by itself."""
    net = toxicity.train([("a bad idiot word here " * 3, 1), ("a fine nice word here " * 3, 0)] * 30)
    texts = ["you idiot", "An  IDIOT, of course. " * 9, "nice words " * 20, "x", None, "  ", "été à la mer " * 15]
    got = {r.k: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), net).collect()}
    for k, t in enumerate(texts):
        words = toxicity.words_of(t)
        if not words:
            assert got[k] == 0.0
            continue
        vectors = []
        for w in words:
            flat, _, own = toxicity.grams([w])
            vectors.append(np.concatenate([net.p["chars"][flat].sum(axis=0) if len(flat) else np.zeros(toxicity.CHAR_DIM), net.p["words"][own[0]]]))
        best = max(slow_logit(net.p, vectors[a : a + toxicity.LENGTH]) for a in range(max(len(words) - toxicity.LENGTH, 0) + 1))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(net.slope * best + net.shift))), abs=1e-5), t


def some_windows(seed, size):
    """A network that isn't trained, and gates and numbers of texts of a few lengths."""
    r = np.random.default_rng(seed)
    net = toxicity.Encoder(seed)
    for k in ("xf", "xb", "hf", "hb", "a"):
        net.p[k] = net.p[k] * np.float32(size)
    gates = net.project(r.standard_normal((300, toxicity.CHAR_DIM + toxicity.WORD_DIM)).astype(np.float32))
    return net, gates, [r.integers(0, 300, n) for n in (3, 20, 21, 400, 57)]


@pytest.mark.parametrize("size", [1, 3])
def test_estimates_are_near_and_the_highest_windows_exact(size, monkeypatch):
    """All windows are estimated without tanh; only those near a text's highest estimate are run, and they are run as ever."""
    net, gates, docs = some_windows(5, size)
    x = np.ascontiguousarray(gates[:, docs[3]].transpose(0, 2, 1))
    want = net.slide(x.copy())
    assert np.abs(net.estimate(x.copy(), net._estimator()) - want).max() < toxicity.MARGIN / 4
    ran, run = [], net.run
    monkeypatch.setattr(net, "run", lambda g, idx, valid: ran.append(len(idx)) or run(g, idx, valid))
    got = net.highest(gates, docs)
    assert sum(ran) < 200 and want.max() == pytest.approx(got[3], abs=1e-5)
    for d, g in zip(docs[1:], got[1:]):
        every = run(gates, d[np.arange(len(d) - toxicity.LENGTH + 1)[:, None] + np.arange(toxicity.LENGTH)], None)
        assert g == pytest.approx(every.max(), abs=1e-5)


@pytest.mark.parametrize("wrong", [0.5, np.nan])
def test_wrong_estimates_have_all_windows_scored(wrong, monkeypatch):
    net, gates, docs = some_windows(6, 1)
    want = net.highest(gates, docs)
    monkeypatch.setattr(net, "estimate", lambda x, w, f=net.slide: f(x)[::-1] + np.float32(wrong))
    assert net.highest(gates, docs) == pytest.approx(want, abs=1e-5)


def test_windows_are_made_in_place():
    """What the driver holds while it learns: the windows once, not an array for each besides."""
    numbers = [np.arange(n, dtype=np.int32) for n in (0, 5, 20, 21, 45, *[3000] * 100)]
    tracemalloc.start()
    try:
        idx, valid, doc = toxicity._windows(numbers)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 2 * (idx.nbytes + valid.nbytes + doc.nbytes)
    assert [(a[v].tolist(), d) for a, v, d in zip(idx[:4], valid, doc)] == [([], 0), ([0, 1, 2, 3, 4], 1), (list(range(20)), 2), (list(range(20)), 3)]
    assert idx[4].tolist() == list(range(1, 21)) and doc[-1] == len(numbers) - 1 and not idx[0].any()
