"""CSV files as chunks, a chunk per row.

`read` is the fast way: Spark splits large files and keeps short rows, padded. Rows that are too wide go, as they do in
`read_exact`, which takes each file as a whole with its encoding detected, and quotes and line ends inside of cells.
`csv_ranges.read` gives the rows of `read_exact` for files of any size, by byte ranges."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators.document import chunk_id
from . import binary

_EXTRA = "_beyond_the_last_column"


def read(spark: SparkSession, path: str, header: list[str] | None = None, **options) -> DataFrame:
    """Rows of CSV files, all as text. A row with more cells than the header goes, one with fewer has nulls."""
    names = header or spark.read.options(header=True, **options).csv(path).columns
    schema = ST.StructType([ST.StructField(n, ST.StringType()) for n in [*names, _EXTRA]])
    rows = spark.read.schema(schema).options(header=True, enforceSchema=True, mode="PERMISSIVE", multiLine=False, **options).csv(path)
    return rows.filter(F.col(_EXTRA).isNull()).drop(_EXTRA)


def row_chunks(rows: DataFrame, doc_id: str, order: list[str], source: str | None = None) -> DataFrame:
    """Chunks of a table's rows: the columns but doc_id as "name: value", numbered by `order` within a document."""
    columns = [c for c in rows.columns if c != doc_id]
    if source and source not in columns:
        raise ValueError(f"there is no column {source!r}")
    i = F.row_number().over(W.partitionBy(doc_id).orderBy(*order)) - 1
    out = rows.select(F.col(doc_id).alias("doc_id"), i.alias("index"), T.csv_row_text([(c, F.col(c)) for c in columns]).alias("content"), (F.col(source).cast("string") if source else F.lit("")).alias("source"))
    return out.withColumn("chunk_type", F.lit("text")).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("index"))).select(*binary.CHUNK_COLUMNS)


def read_exact(spark: SparkSession, path: str, encoding: str | None = None, source_column: str | None = None, **csv_options) -> DataFrame:
    """Chunks of CSV files as pandas reads them; a file at a time, so that a file has to fit a worker's memory.

    A file that can't be read gives one chunk of type `error` with the reason."""

    return exact_chunks(binary.files(spark, path), encoding, source_column, **csv_options)


def exact_chunks(files: DataFrame, encoding: str | None = None, source_column: str | None = None, **csv_options) -> DataFrame:
    """The same for files that are rows already: (path, content)."""

    def rows(batches):
        for pdf in batches:
            for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
                try:
                    if text is None:
                        raise ValueError(binary.NO_ENCODING)
                    df = pd.read_csv(io.StringIO(text), on_bad_lines="skip", **csv_options)
                    if source_column and source_column not in df.columns:
                        raise ValueError(f"there is no column {source_column!r}")
                    content = [";".join(f"{str(c).strip()}: {str(v).strip()}" for c, v in row.items()) for _, row in df.iterrows()]
                    named = [str(v) for v in df[source_column]] if source_column else [""] * len(df)
                    if content:  # a header alone has no rows
                        yield pd.DataFrame({"doc_id": doc, "index": range(len(df)), "chunk_type": "text", "content": content, "source": named})
                except (ValueError, pd.errors.ParserError) as e:
                    yield pd.DataFrame({"doc_id": [doc], "index": [0], "chunk_type": ["error"], "content": [str(e)], "source": [source]})

    f = files.select(binary.doc_key(), F.col("path").alias("source"), binary.decode(F.col("content"), encoding).alias("text"))
    got = f.mapInPandas(rows, "doc_id long, index int, chunk_type string, content string, source string")
    return got.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("index"))).select(*binary.CHUNK_COLUMNS)
