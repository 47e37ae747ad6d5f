"""A corpus for training, in stages: each works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, neardup, quality, tokens
from tessera.llm.scratch import Scratch


#: Columns that the stages read; all others are carried along under names of their own.
READ = ("doc_id", "text", "source")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage reads renamed, so that no result replaces them."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"__t_c{i}") for i, c in enumerate(docs.columns)])


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return out.select(*[F.col(f"`{c}`" if c in READ else f"__t_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as texts without features; repeated rows
    get the same score; an empty table gives none.  Held-out labels are not read.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    model = quality.train(docs, labels)
    return _restored(quality.score_quality(_apart(docs), model).where("predicted = 1"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, nulls last.

    Null and empty texts are equal; of repeated rows one stays; an empty table gives none.
    """
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole window of benchmark words, and are less than a twentieth of shorter items.

    A document that quotes thirteen words of an item in a row has seen it,
    however long it is.  Null and empty texts have no words and stay; repeated
    rows are judged alike; an empty table or benchmark drops none.
    """
    found = decontam.find_leaks(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _restored(found.where((F.col("n_hit") < decontam.SPAN) & ~decontam.contaminated()), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and are not taken; a null source is one;
    repeated rows share the copies that fall to them; an empty table gives none.
    """
    mixed = mixing.mix_sources(_apart(docs)).where("copies > 0")
    return _restored(mixed.withColumn("__t_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, as written to the shards.

    Null and empty texts are a sequence without tokens; each of repeated rows has its own; an empty table gives none.
    """
    scratch = Scratch(spark, "tokens")
    return tokens.write_training_order(docs, f"{scratch.path}/shards", scratch=scratch)


STAGES = [
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("tokens", write_tokens),
]

#: Classifier, sampled similarity and Newton steps have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
