"""Sentences by learnt abbreviations: hand-marked texts, odd rows, and the plan."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import chunking, sentences

#: Marked by hand: a bar ends a sentence.
MARKED = [
    "Dr. Smith arrived at five p.m. in the rain.| Nobody had met him.| Mr. Jones left early.",
    "The firm Baker & Co. Ltd. was sold in Jan. 1999 for a small sum.| It never recovered!| Why not?| Nobody knows.",
    "She met Prof. Miller and Dr. Weber, e.g. at noon, etc. and so on.| The talk was long.",
    "J. R. Miller wrote it.| W. Smith printed it.",
    "He lives in St. Louis.| The house is old.| Mrs. Weber lives there too.",
    'He said "We leave at five."| The others stayed.| Mr. Weber slept... and nobody woke him.| Mrs. Jones did.',
    "They came at nine a.m. The doors were shut.".replace("a.m. The", "a.m.| The"),
    "The score was 3.5 to 4.| It rained.| No. 5 won.",
]


@pytest.fixture(scope="module")
def corpus(spark):
    """Plain sentences in which the abbreviations of the marked ones, and their other words, are common."""
    r = random.Random(4)
    names = ["Smith", "Jones", "Miller", "Weber", "Louis"]
    words = "the house is old it rained nobody knows him talk was long firm sold others stayed doors were shut he she they we lives there left early".split()
    short = ["Dr.", "Mr.", "Mrs.", "Prof.", "St."]
    rows = []
    for i in range(1500):
        kind = r.randrange(6)
        body = " ".join(r.choice(words) for _ in range(r.randint(4, 9)))
        if kind == 0:
            body = f"{r.choice(short)} {r.choice(names)} {body}"
        elif kind == 1:
            body = f"{body} at {r.choice(['five', 'nine'])} {r.choice(['a.m.', 'p.m.'])} {r.choice(['in the rain', 'or so'])}"
        elif kind == 2:
            body = f"{body}, {r.choice(['e.g.', 'etc.'])} {body}"
        elif kind == 3:
            body = f"the firm {r.choice(['Baker', 'Klein'])} & Co. Ltd. {body}, No. {i % 40} in Jan. {1900 + i % 90}"
        elif kind == 4:
            body = f"{r.choice('JRWK')}. {r.choice(names)} {body}"
        rows.append((i % 40, i, body[0].upper() + body[1:] + r.choice([".", ".", ".", "!", "?"])))
    texts = {}
    for doc, _, s in rows:
        texts[doc] = texts.get(doc, "") + s + " "
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def model(corpus):
    return sentences.learn(corpus)


def cut(spark, model, texts):
    rows = sentences.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    got = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        got[r.doc_id].append(r.chunk)
    return [got[i] for i in range(len(texts))]


def test_learnt_abbreviations(model):
    got = {r.type for r in model.abbreviations.collect()}
    assert {"dr", "mr", "mrs", "prof", "st", "a.m", "p.m", "e.g", "etc", "co", "ltd", "jan", "no"} <= got
    assert not got & {"old", "him", "long", "knows", "shut", "house", "early", "smith"}


def test_hand_marked_sentences(spark, model):
    want = [[s.strip() for s in m.split("|")] for m in MARKED]
    assert cut(spark, model, [m.replace("|", "") for m in MARKED]) == want


def test_the_pattern_alone_cuts_them(spark):
    text = MARKED[0].replace("|", "")
    got = spark.createDataFrame([(text,)], "text string").select(chunking.sentence_chunks(F.col("text")).alias("s")).first().s
    assert "Dr." in got


def test_odd_texts(spark, model):
    long = "Dr. Smith left. " + "The house is old and long " * 20_000 + ". It rained."
    texts = [None, "", " \n", "no end", ".", "!!! ???", "Nobody knows. Nobody knows.  Him.", long, "a.b.c", "Ende. Neu. Da."]
    got = cut(spark, model, texts)
    assert got[:6] == [[], [], [], ["no end"], ["."], ["!!!", "???"]]
    assert got[6] == ["Nobody knows.", "Him."] and len(got[7]) == 3 and got[8] == ["a.b.c"] and got[9] == ["Ende.", "Neu.", "Da."]
    docs = spark.createDataFrame([(None, "One. Two.", 1), (None, "One. Two.", 1), (3, None, 1)], "doc_id long, text string, pos int")
    assert sorted(r.chunk for r in sentences.sentences(docs, model).collect()) == ["One.", "One.", "Two.", "Two."]
    assert sentences.sentences(docs.limit(0)).collect() == []
    assert chunking.chunk(docs, "learned_sentence", model=model).count() == 4


def test_no_pieces_are_lost(spark, corpus, model):
    found = sentences.segments(corpus, ["doc_id"])
    whole = found.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "segment"))), lambda x: x["segment"]), "").alias("t"))
    assert whole.join(corpus, "doc_id").filter(F.col("t") != F.ltrim("text")).count() == 0


def test_no_nested_loops(corpus, model):
    plan = sentences.sentences(corpus, model)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_counts_of_words_at_odd_ends(spark):
    """Equal words are counted together by where they stand; `...`, closing marks and marks inside of words."""
    docs = spark.createDataFrame([("  No. Yes! a.b c... Der d. “Der.” Der",), ("...",), (None,), ("x?!y Der",)], "text string")
    got = {r.type: (r.n_period, r.n_plain, r.n_lower, r.n_upper_inside) for r in sentences.words(docs).collect()}
    assert got["der"] == (1, 3, 0, 1)
    assert got["a.b"] == (0, 1, 1, 0) and got["no"] == (1, 0, 0, 0) and got["c"] == (0, 1, 1, 0)
    ends = {(r.x, r.y): r.kind for r in sentences.ends(sentences.segments(docs, [])).collect()}
    assert ends == {("No.", "Yes!"): ".", ("Yes!", "a.b"): "!", ("c...", "Der"): "..", ("d.", "“Der.”"): ".", ("“Der.”", "Der"): "."}


def test_result_cuts_texts_once(spark, data):
    """What was counted to learn is kept, so that pairs aren't looked for in the texts again."""
    df = chunking.chunk(spark.read.parquet(f"{data}/documents.parquet"), "learned_sentence")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_simple_words_are_as_others(spark):
    words = ["word", "Word.", "end!", "END?", "a,", "B;", "e:", "a.m.", "(x)", "É.", "é", "12.", "x..", "'s", "No.", "Y"]
    d = spark.createDataFrame([(w,) for w in words], "x string")
    s = sentences
    got = d.select("x", s._type_of(F.col("x")), s._case_of(F.col("x")), s._kind_of(F.col("x"))).collect()
    assert got == d.select("x", s.word_type(F.col("x")), s._case(F.col("x")), s._kind(F.col("x"))).collect()
