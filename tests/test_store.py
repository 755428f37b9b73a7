"""Versions of documents: repeated batches, readers at a version, writers at once, and equality with a dictionary."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from pagewright.store import Conflict, Store

SCHEMA = "doc_id long, chunk int, text string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store", buckets=3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)], SCHEMA)


def test_against_a_dictionary(spark, store):
    r, want, history = random.Random(4), {}, {}
    for n in range(8):
        put = {r.choice([None, *range(12)]): [f"{n}.{i}" for i in range(r.randint(1, 3))] for _ in range(r.randint(1, 5))}
        gone = [(d,) for d in r.sample([None, *range(12)], 3)]
        v = store.write(f"batch-{n}", frame(spark, put), spark.createDataFrame(gone, "doc_id long") if n % 2 else None)
        if n % 2:
            for (d,) in gone:
                want.pop(d, None)
        want |= put
        history[v] = sorted(((d, i, t) for d, texts in want.items() for i, t in enumerate(texts)), key=str)
        if n == 5:
            assert store.compact() == v + 1 and rows(store.read()) == history[v]
            history[v + 1] = history[v]
    assert store.versions() == sorted(history)
    for v, expected in history.items():
        assert rows(store.read(v)) == expected


def test_a_repeated_batch_changes_nothing(spark, store):
    first = store.write("a", frame(spark, {1: ["one"]}))
    second = store.write("b", None, spark.createDataFrame([(1,)], "doc_id long"))
    assert store.write("a", frame(spark, {1: ["one"]})) == second == first + 1
    assert store.versions() == [1, 2] and rows(store.read()) == []


def test_a_reader_stays_at_its_version(spark, store):
    store.write("a", frame(spark, {1: ["old"], 2: ["x"]}))
    reader = store.read()
    store.write("b", frame(spark, {1: ["new", "newer"]}))
    assert rows(reader) == [(1, 0, "old"), (2, 0, "x")]
    assert rows(store.read()) == [(1, 0, "new"), (1, 1, "newer"), (2, 0, "x")] and rows(store.read(1)) == rows(reader)


def test_writers_at_once(spark, store):
    store.write("start", frame(spark, {0: ["zero"]}))
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: store.write(f"w{i}", frame(spark, {i: [str(i)]})), range(1, 5)))
    assert sorted(made) == [2, 3, 4, 5]
    assert [r[0] for r in rows(store.read())] == [0, 1, 2, 3, 4]


def test_a_taken_version(spark, store, monkeypatch):
    monkeypatch.setattr(Store, "_commit", lambda self, m: False)
    with pytest.raises(Conflict):
        store.write("a", frame(spark, {1: ["x"]}), attempts=2)
    assert store.versions() == []


def test_clean_columns_and_emptiness(spark, store):
    assert rows(store.read()) == []
    store.write("empty", frame(spark, {}))
    assert rows(store.read()) == []
    store.write("a", frame(spark, {1: ["x"]}))
    store.write("more", spark.createDataFrame([(2, "y", 7)], "doc_id long, text string, extra int"))
    assert store.read().columns == ["doc_id", "chunk", "text", "extra"] and rows(store.read()) == [(1, 0, "x", None), (2, None, "y", 7)]
    with pytest.raises(ValueError, match="extra"):
        store.write("bad", spark.createDataFrame([(2, "y", "z")], "doc_id long, text string, extra string"))
    v = store.compact()
    assert len(store.clean(1)) == 4 and store.versions() == [v] and len(rows(store.read())) == 2
    with pytest.raises(ValueError, match="something"):
        store.write("none")
