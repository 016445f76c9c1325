"""From raw documents to sharded training data, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and
returns documents with the columns of ``documents``; the last returns their shards. Null texts count as
empty, rows with a null id stay, an empty table passes all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.shared import remove_folder, shared_folder, table, tables_of_block
from skein.llm import automaton, classifier, mixing, sharding, simhash

FINGERPRINTS = 8
#: Words of the shingles that decide on near duplicates, and of those that bring pairs together.
SHINGLE, BLOCK_SHINGLE = 5, 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(classifier.quality_score(F.col("text"), model, spark) >= classifier.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, of the smallest id: groups of a similarity of about 0.8 or more of five-word shingles."""
    return simhash.drop_near_duplicates(docs, shingle=SHINGLE, count=FINGERPRINTS, block_shingle=BLOCK_SHINGLE, spread=simhash.SPREAD_FIVE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that stand in a benchmark item; those that are mostly such spans go."""
    return automaton.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of a source, those with a higher share of letters are the likelier. The weight is a SQL expression, as mixing is native throughout; the classifier has had its say in the first stage."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    mixed = mixing.mix(packed, keep=["_row"]).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document of the mix."""
    return sharding.shard(docs, keep=["doc_id"]).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversized")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier, a trained network, has no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written to the shared folder and read again; what a later stage no longer needs is deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with tables_of_block(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_folder(spark, last)
        last = path
    return docs
