"""Cutting a plan's lineage through storage that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="posturelake-")
        sc.setCheckpointDir(folder)
    return folder


#: For what writes Parquet: digests hardly ever repeat, so that no dictionary of them is begun.
DIGESTS_PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("dedupe_key", "fingerprint")}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs within deletes its shuffle files as it ends. Else they stay until the driver collects garbage, which takes long where its memory is large."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but kept as Parquet: compressed, and read by column; for what is large. Digests, of which hexadecimal digits tell half a byte each, need Zstandard. A folder lasts as long as the checkpoint folder, unless ``drop_stored`` deletes it."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.options(compression="zstd", **DIGESTS_PLAIN).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, column: str, values: Iterable[str]) -> dict[str, DataFrame]:
    """``stored`` in a folder for each of the texts ``values`` of ``column``, which is dropped; each is read with its own size."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    empty = spark.range(1).select(*[F.explode(F.array(*map(F.lit, values))).alias(c) if c == column else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])  # a folder for a value without rows
    df.withColumn("__row", F.lit(True)).unionByName(empty.withColumn("__row", F.lit(False))).write.partitionBy(column).parquet(folder)
    schema = df.withColumn("__row", F.lit(True)).drop(column).schema
    return {v: spark.read.schema(schema).parquet(f"{folder}/{column}={v}").where("__row").drop("__row") for v in values}


def drop_stored(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, which is not read again."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared checkpoint folder and return it without its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
