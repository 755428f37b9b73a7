"""From raw documents to token ids: toxic documents go, near duplicates go but one, repeated passages go, contaminated
documents go, and what is left is encoded.

Every stage takes (spark, docs, sf_dir), works on all rows that it is given, and returns a table; all but the last
return the columns of `documents`. `run` writes each stage's table to the shared folder and reads it again, so that a
lost executor costs one stage at most; a stage's table goes when the next one is written.

Defined results: null and empty texts stay through all stages and have no tokens; repeated ids: see the operators; an
empty table gives an empty table; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, common, decontam, neardup, suffix_dedup, toxicity
from pagewright.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; learnt from the labelled rows that may be learnt from."""
    return toxicity.remove(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return neardup.deduplicate(docs, 5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of more than 50 words that occur elsewhere too; n_chars follows."""
    got = suffix_dedup.remove_repeats(docs, unit=suffix_dedup.by_words(51))
    return got.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    return decontam.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids."""
    return bpe.digests(docs, TOKENIZER, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", cut_repeats), ("decontamination", drop_contaminated), ("bpe", encode)]

#: SQL can't express the trained first stage; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = common.scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if last:
            common.discard(spark, last)
        docs, last = spark.read.parquet(out), out
    return docs
