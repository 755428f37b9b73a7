"""Files as rows, and what their bytes are."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.document import chunk_id


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, content and length of the files below a path. Spark's reader passes by files without bytes: they have no row."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "length", "content")


def doc_key(path: str = "path") -> F.Column:
    """A document's id, from its path: the same on every run."""
    return F.xxhash64(F.col(path)).alias("doc_id")


def sniff_pdf(content: str = "content") -> F.Column:
    return F.when(F.substring(F.col(content), 1, 4) == F.lit(b"%PDF"), "pdf").otherwise("other")


def detect_encoding(content: F.Column) -> F.Column:
    """array<struct<encoding, confidence, language>>, the likeliest first; valid UTF-8 is that."""

    def detect(data: pd.Series) -> pd.Series:
        from charset_normalizer import from_bytes

        out = []
        for b in data:
            if b is None:
                out.append(None)
                continue
            try:
                bytes(b).decode("utf-8")
                out.append([{"encoding": "utf_8", "confidence": 1.0, "language": None}])
            except UnicodeDecodeError:
                found = from_bytes(bytes(b))
                out.append([{"encoding": m.encoding, "confidence": float(1 - m.chaos), "language": m.language} for m in found])
        return pd.Series(out)

    return F.pandas_udf(detect, "array<struct<encoding:string,confidence:double,language:string>>")(content)


def decode(content: F.Column, encoding: str | None = None) -> F.Column:
    """Text of bytes: by the encoding that is named, else by the likeliest one. None fits: null."""
    if encoding:
        codecs.lookup(encoding)  # an unknown name is the caller's mistake, not the file's

    def text(data: pd.Series) -> pd.Series:
        from charset_normalizer import from_bytes

        def one(b):
            if b is None:
                return None
            b = bytes(b)
            try:
                return b.decode(encoding or "utf-8-sig")
            except UnicodeDecodeError:
                if encoding:
                    return None
            best = from_bytes(b).best()
            return None if best is None else str(best)

        return data.map(one)

    return F.pandas_udf(text, "string")(content)


CHUNK_COLUMNS = ["doc_id", "index", "chunk_id", "chunk_type", "content", "source"]
NO_ENCODING = "no encoding fits"


def one_chunk(texts: DataFrame) -> DataFrame:
    """A chunk for each whole text: (doc_id, text, source) to chunks."""
    return texts.select("doc_id", F.lit(0).alias("index"), chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"), F.lit("text").alias("chunk_type"), F.col("text").alias("content"), "source")


def read_text(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """One chunk per text file; the encoding is detected unless it is named. A file that none fits gives a chunk of type
    `error`."""
    return text_chunks(files(spark, path), encoding)


def text_chunks(f: DataFrame, encoding: str | None = None) -> DataFrame:
    """The same for files that are rows already: (path, content)."""
    got = one_chunk(f.select(doc_key(), decode(F.col("content"), encoding).alias("text"), F.col("path").alias("source")))
    return got.withColumns({"chunk_type": F.when(F.col("content").isNull(), "error").otherwise(F.col("chunk_type")), "content": F.coalesce("content", F.lit(NO_ENCODING))})
