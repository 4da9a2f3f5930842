"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression's class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a function over texts sees at once. Arrow batches themselves are bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch.
TEXT_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Runs of other than ASCII white space, as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` by executors that have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def map_texts(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``map_batches`` with slices of few rows, so that what ``f`` makes of a slice of long texts fits a Python worker."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(b.slice(i, TEXT_ROWS) for b in batches for i in range(0, b.num_rows, TEXT_ROWS))

    return map_batches(df, sliced, schema)


def nested(df: DataFrame, **more: Column) -> DataFrame:
    """The row as a struct ``doc`` beside the columns ``more``, whose names then cannot clash with the row's own."""
    return df.select(F.struct("*").alias("doc"), *[x.alias(name) for name, x in more.items()])


#: Rows of at most a few hundred bytes that a table may have to be broadcast; the count is taken before.
BROADCAST_ROWS = 20_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, which is cheap to count, marked for broadcast if it has few rows; else Spark shuffles and splits hot keys."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python needs it for the functions that it maps over batches. Once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='posturelake-')}/posturelake", "zip", root, "posturelake"))
        _shipped.add(sc.applicationId)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this library made in the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
