"""The corpus pipeline: rejects, repeated lines, near copies, the mix of sources, and packed sequences."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posturelake.llm import quality
from posturelake.llm.common import drop_folder
from posturelake.llm.linededup import dedup_lines
from posturelake.llm.mixing import mixed_documents
from posturelake.llm.packing import pack_documents
from posturelake.llm.simhash import drop_near_copies
from posturelake.plans.lineage import checkpoint_folder



def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their distance from their language and source reject go, each row by its own verdict, whatever shares its id. Null and empty texts go."""
    return quality.drop_rejected(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share go from all but the one of largest id; a text may become empty. A null text stays null; n_chars is counted anew where lines went."""
    fresh = {"text": F.when(F.col("doc.text").isNotNull(), F.col("kept")), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("doc.n_chars"))}
    return dedup_lines(docs).select(*[fresh.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of least id stays, and all rows without an id; empty texts are one group."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times; texts without a word go."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences. Rows that repeat an id are documents of their own, a null or empty text is the end id alone."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", drop_rejected),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

#: Fingerprints, robust estimates, sampling and tokenizing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet to the shared folder and read again.

    An empty table passes all stages as one; columns beyond those of documents pass the stages before the last. What a stage wrote is deleted once the next has been written.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
