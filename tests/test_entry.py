"""The driver contract without the optional subpackage, and the shared folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from pagewright import session

ROOT = Path(__file__).resolve().parents[1]
ASK = "import warnings; warnings.simplefilter('error'); import __spark_entry__ as e; from pagewright.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES) and e.oracle_sql() == catalog.SQL"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_without_the_subpackage(tmp_path, with_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    if not with_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_discarded_tables_are_gone(spark):
    path = session.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    session.discard(spark, path)
    assert not Path(path.removeprefix("file:")).exists()
