"""Dumps of stage tables are packed, and read again as they were."""

from pyspark.sql import functions as F

from pagewright import sinks


def test_dump_is_packed(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 20).cast("int").alias("pnum"), F.lit("the same words again and again").alias("text"))
    sinks.dump({"spans": rows}, str(tmp_path))
    parts = [p for p in (tmp_path / "spans").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    assert spark.read.schema("pnum int, text string").json(f"{tmp_path}/spans").exceptAll(rows.filter("pnum < 10")).count() == 0
