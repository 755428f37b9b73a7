"""Large CSV files by byte ranges: equal to reading whole files, for ranges from one byte up."""

import random
from collections import Counter

import pytest

from pagewright.sources import csv, csv_ranges

FILES = {
    "plain.csv": "a,b,c\n1,2.5,x\n2,,y\n\n3,4,\n",
    "quoted.csv": 'id,text,n\n1,"two\nlines, and ""more""\n\n",5\r\n2,"""\n""",\n3,plain "quote" inside,7\n4,"a"b"c,8\n5,"",9\n',
    "wide.csv": "a,b\n1,2\n1,2,3\n4\n\n  \n5,6\n",
    "types.csv": "i,f,t,e,z\n007,1,x,,True\n8,2,3,,False\n9,3.5,,,\n",
    "ints.csv": "a,b\n1,2\n3,4\n",
    "mixed.csv": "a,b\n1,2.0\n3,4\n,5\n",
    "late.csv": "a,b\n" + "".join(f"{i},{i}\n" for i in range(12)) + "x,\n",
    "head.csv": '"a\nb",c\n1,2\n',
    "index.csv": "a,b\nx,1,2\ny,3,4\n",
    "only.csv": "a,b\n",
    "no end.csv": 'a,b\n1,"x"',
    "one+two %.csv": "a,a\n1,2\n",
    "blank.csv": "\n\n",
    "open.csv": 'a,b\n1,"x\n2,y\n',
}


def shown(df):
    """Rows without the wording of errors."""
    return Counter((r.doc_id, r["index"], r.chunk_id, r.chunk_type, r.content if r.chunk_type == "text" else "", r.source) for r in df.collect())


@pytest.fixture
def ranges(spark, monkeypatch):
    """Gives files ranges of a size, from one byte up, as Spark's own splits do: a line belongs to the range in which it
    begins. (Spark's setting would cut the stored tables up too.)"""

    def put(size):
        def lines(spark_, path):
            rows = {}  # by range, which one task reads
            for r in csv.binary.files(spark_, path).orderBy("path").collect():
                at = 0
                for value in bytes(r.content).split(b"\n"):
                    if at < r.length:
                        rows.setdefault((r.path, at // size * size), []).append((r.path, at // size * size, value))
                    at += len(value) + 1
            return spark_.createDataFrame(spark_.sparkContext.parallelize(list(rows.values()), 3).flatMap(list), "path string, block long, value binary")

        monkeypatch.setattr(csv_ranges, "lines", lines)

    return put


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (path / name).write_bytes(text.encode())
    return path


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 20])
def test_equal_to_whole_files(spark, folder, ranges, size):
    want = shown(csv.read_exact(spark, str(folder), "utf-8"))
    assert len({k[0] for k in want}) == len(FILES) - 1  # a header alone has no rows
    ranges(size)
    assert shown(csv_ranges.read(spark, str(folder), "utf-8")) == want


def test_random_quotes(spark, tmp_path, ranges):
    r = random.Random(6)
    for i in range(12):
        body = "".join(r.choice(['"', '"', ",", "\n", "a", "1", " ", '""', '"\n"', "\r\n"]) for _ in range(60))
        (tmp_path / f"{i}.csv").write_bytes(("x,y,z\n1,2,3\n" + body + '"\n').encode())
    want = shown(csv.read_exact(spark, str(tmp_path), "utf-8"))
    assert sum(k[3] == "text" for k in want) > 20
    ranges(5)
    assert shown(csv_ranges.read(spark, str(tmp_path), "utf-8")) == want


def test_encodings_sources_and_pieces(spark, tmp_path, ranges, monkeypatch):
    monkeypatch.setattr(csv_ranges, "PIECE", 100)
    text = "näme;n\n" + "".join(f'"é {i}\n{"x" * (i % 50)}";{i if i % 7 else ""}\n' for i in range(200))
    (tmp_path / "a.csv").write_bytes(text.encode("latin-1"))
    ranges(700)
    got = csv_ranges.read(spark, str(tmp_path), "latin-1", ";", "näme")
    assert shown(got) == shown(csv.read_exact(spark, str(tmp_path), "latin-1", "näme", sep=";"))
    assert [(r.chunk_type, r.content) for r in csv_ranges.read(spark, str(tmp_path), "utf-8", ";").collect()] == [("error", "no encoding fits")]
    assert [r.content for r in csv_ranges.read(spark, str(tmp_path), "latin-1", ";", "none").collect()] == ["there is no column 'none'"]


def test_a_record_that_is_too_long(spark, tmp_path, ranges, monkeypatch):
    monkeypatch.setattr(csv_ranges, "RECORD", 50)
    (tmp_path / "a.csv").write_bytes(b'a,b\n1,"' + b"x\n" * 40 + b'"\n2,3\n')
    ranges(16)
    assert [(r.chunk_type, r.content) for r in csv_ranges.read(spark, str(tmp_path)).collect()] == [("error", "a record is too long")]


def test_ranges_of_spark(spark, tmp_path):
    """No task reads more than its range, and one borders row each, of a large file."""
    body = b"a,b\n" + b"".join(b'%d,"line\nend"\n' % i for i in range(5000))
    (tmp_path / "a.csv").write_bytes(body)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "16384")
        found = csv_ranges.lines(spark, str(tmp_path))
        sizes = found.rdd.mapPartitions(lambda rows: [sum(len(r.value) + 1 for r in rows)]).collect()
        assert sum(sizes) == len(body) and max(sizes) <= 16384 + 20 and len(sizes) > 4
        got = csv_ranges.read(spark, str(tmp_path)).select("index", "content").collect()
        assert sorted((r["index"], r.content) for r in got) == [(i, f"a: {i};b: line\nend") for i in range(5000)]
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
