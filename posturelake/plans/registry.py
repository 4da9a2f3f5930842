"""Registry of queries: each has a name, a function of the inputs and, where SQL can express it, SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .evidence import evidence
from .lineage import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FUNCTIONS: dict[str, Callable[[Inputs], DataFrame]] = {}


class Inputs:
    """What a query reads: tables of a folder, views over them, and canonical evidence."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)

    def evidence(self, *names: str) -> dict[str, DataFrame]:
        return evidence(self.spark, self.sf_dir, set(names))

    def folder(self, kind: str) -> str:
        """A new folder that all executors share."""
        return f"{checkpoint_folder(self.spark)}/{kind}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``f(inputs)`` under ``name``; ``sql`` may name the fixture views."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        FUNCTIONS[name] = f
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[name] = views.with_views(sql)
        return f

    return add


def flat_map(attributes: str) -> Column:
    """A map as ``k=v;k=v`` in order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def flat_matches(m: DataFrame) -> DataFrame:
    return m.select("host_id", "rule_id", F.coalesce("title", F.lit("")).alias("title"), F.array_join(F.array_sort("objects"), ",").alias("objects"), flat_map("attributes").alias("attributes"))


def cases(column: str, values: list[str]) -> str:
    """SQL that picks one of some texts by the remainder of a number; Spark and DuckDB read it alike."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {column} % {len(values)} {arms} END"
