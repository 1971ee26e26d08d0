"""From raw documents to packed training sequences: five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import decontamination, packing, quality, simhash, toxicity
from twinlens.llm.common import crc_mod, discard, materialize, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality. Labels of ids whose crc32 mod 3 is 1 stay unseen, as for the accuracy that is measured."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod(F.col("doc_id"), 3) != 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. Labels of ids whose crc32 mod 5 is 0 stay unseen."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod(F.col("doc_id"), 5) != 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.packed_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Classifiers, fingerprints and token ids aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder; what a stage needs no more is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as folders:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            folders.remove(docs.written_to)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
