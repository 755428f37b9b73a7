"""Session helpers shared by tests, the benchmark and the driver contract."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution and UTC; a session that is there already is returned as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which becomes the checkpoint folder. Where it is unset, a session in one
    process gets a temporary folder; on a cluster, whose machines wouldn't see that, it is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster see")
        base = tempfile.mkdtemp(prefix="pagewright-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/pagewright/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables below the shared folder that no plan reads any more."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for a context, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if not getattr(sc, "_pagewright_shipped", False):
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="pagewright-"), "pagewright_src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((root / "pagewright").rglob("*.py")):
                z.write(p, str(p.relative_to(root)))
        sc.addPyFile(path)
        sc._pagewright_shipped = True
    return spark
