"""Files and tables as they arrive, and what writes streams. Keyed state is in `assemble`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import chunking
from ..sources import binary


def text_files(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A stream of one chunk per text file below a folder."""
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return binary.text_chunks(f, encoding)


def documents(spark: SparkSession, path: str, schema, strategy: str = "fixed", **options) -> DataFrame:
    """A stream of chunks of a documents table that grows by files."""
    docs = spark.readStream.schema(schema).parquet(path)
    return chunking.chunk(docs, strategy, **options)


def write(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run what is there now, batch by batch; a restart goes on after the last whole batch.

    The sink sees a batch again after a failure, so that it has to write by batch number."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, the same one when it comes again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put
