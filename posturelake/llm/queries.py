"""Queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, fmindex, hamming, linededup, spelling, urlfilter, warc
from .common import documents
from .linededup import line_report
from .mixing import mix
from .packing import pack_documents
from .quality import quality
from .sharding import shard
from .simhash import simhash_groups
from .tokencount import count_tokens


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.query(spark, sf_dir)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.query(spark, sf_dir)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.query(spark, sf_dir).drop("spans", "digest")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.query(spark, sf_dir)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.query(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_simhash, op2_token_counts, op3_quality, op4_packing, op5_mixing, op6_sharding, op7_hamming_top_k, op8_url_filter, op9_line_dedup, op10_warc, op11_decontamination, op12_spelling, op13_conversations)
}
ORACLES: dict[str, str] = {"op7_hamming_top_k": hamming.ORACLE, "op9_line_dedup": linededup.ORACLE, "op10_warc": warc.ORACLE, "op11_decontamination": fmindex.ORACLE, "op12_spelling": spelling.ORACLE}
