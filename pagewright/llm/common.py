"""What the operators of this package share: shipping code, batches, stored tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import discard, scratch, shared_folder, table  # noqa: F401
from ..session import ship as _ship

#: Rows of an Arrow batch. Texts are whole, so that a batch has to be small in rows.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once, and keep the session's Arrow batches small. Plans run later than they are
    made, so that the setting stays; a smaller one of the user's is kept."""
    if not 0 < int(spark.conf.get(_ROWS, "0")) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return _ship(spark)


#: What workers remember, by operator: called to forget it. Python workers live on from stage to stage.
CACHES: dict[str, Callable[[], None]] = {}


def only(name: str) -> None:
    """Forget what other operators left in this worker's memory."""
    for k, forget in CACHES.items():
        if k != name:
            forget()


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; Spark removes it when nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Store:
    """Tables of one run, written to a new folder below the shared one and read again."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, scratch(spark, name)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        discard(self.spark, *(f"{self.path}/{n}" for n in names))
        tidy(self.spark)


def tidy(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of finished queries, which they keep until the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def plus(df: DataFrame, name: str, kind: str) -> StructType:
    """The table's schema and one more column (StructType.add would change the table's own)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


def training_row(doc_id) -> F.Column:
    """Whether labels of a document may be learnt from: crc32 of its id's digits, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
