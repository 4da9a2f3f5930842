"""Text lines, events and evidence as tables (SRC-05 to SRC-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.secrets import REDACTED, secret_shaped
from ..plans.lineage import cut
from ..plans.numbering import number_rows

#: How times of events are written as JSON; without it Spark writes milliseconds.
EVENT_TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
EVENT = "execution_id string, ts timestamp, event string, level string, data map<string,string>"


def read_events(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """SRC-05: the JSON-lines event envelope, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).json(folder)


def _in_file_order(rows: DataFrame) -> DataFrame:
    """``pos`` of each row (path, block, ...) of a scan in its file, from 0. A row per block is all that is summed up over a file.

    A block's rows stand together in the task that reads it, in the file's order, so that their count from its first row places them; the blocks are placed by the counts of those before.
    """
    read = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    blocks = read.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return read.join(blocks, ["path", "block"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "block", "first", "before")


def read_lines(spark: SparkSession, folder: str, blank: bool = True) -> DataFrame:
    """(path, line, pos) of text files: lines between newlines, and their places from 0. Without ``blank``, places count the other lines, and carriage returns are gone.

    A large file is read in blocks by many tasks. A newline at the end of a file starts no line.
    """
    text = spark.read.option("lineSep", "\n").text(folder)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return _in_file_order(rows if blank else _clean(rows))


def _clean(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", "\r", "")).where(F.trim("line") != "")


def first_lines(lines: DataFrame, most: int | None = None, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """SRC-06: without carriage returns and blank lines; ``line_no`` counts from 1, and the first ``most`` stay. A file of any size is numbered by many tasks."""
    out = number_rows(_clean(lines), [F.col("pos")], within=by, out="line_no").withColumn("line_no", (F.col("line_no") + 1).cast("int"))
    return out if most is None else out.where(F.col("line_no") <= most)


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """SRC-07: hash of the data unless given, the first known time, and secret-shaped data redacted."""
    bad = secret_shaped(F.col("data"))
    return evidence.withColumns(
        {
            "hash": F.coalesce(F.nullif("hash", F.lit("")), F.sha2("data", 256)),
            "timestamp": F.coalesce("timestamp", "collected_at", F.current_timestamp()),
            "mode": F.when(bad, "full").otherwise(F.col("mode")),
            "data": F.when(bad, REDACTED).otherwise(F.col("data")),
        }
    )
