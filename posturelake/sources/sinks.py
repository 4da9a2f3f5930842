"""Report and table sinks (SNK-01, SNK-02)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.secrets import redact_attributes
from ..plans.lineage import DIGESTS_PLAIN, drop_stored, shuffles_dropped, stored
from ..plans.numbering import number_rows


#: Rows of a written file, and documents of one.
ROWS, DOCUMENTS = 1_000_000, 1_000
REPORT_ROW = "host_id long, part string, place long, body string"
#: What rows of reports go by.
ORDER = ("host_id", "part", "place")


def _redacted(df: DataFrame) -> DataFrame:
    return df.withColumn("attributes", redact_attributes(F.col("attributes"))) if "attributes" in df.columns else df


def report_texts(**parts: DataFrame) -> DataFrame:
    """As ``report_rows``, with ``body`` as JSON text, which takes half the time and room where rows are but written."""
    out = []
    for part, df in parts.items():
        rest = [c for c in df.columns if c not in ("host_id", "place")]
        body = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
        placed = _redacted(df) if "place" in df.columns else number_rows(_redacted(df), [F.to_json(F.struct(*rest))], within=["host_id"], out="place", keep=stored).withColumn("place", F.col("place") + 1)
        out.append(placed.select("host_id", F.lit(part).alias("part"), F.col("place").cast("long").alias("place"), body.alias("body")))
    return reduce(DataFrame.union, out)


def report_rows(**parts: DataFrame) -> DataFrame:
    """SNK-01 as rows: (host_id, part, place, body) of tables with ``host_id``, by the name of their part. ``body`` holds a row's other columns as VARIANT, with secret-shaped attributes redacted.

    A table that has no column ``place`` is numbered by its columns. No host is gathered, so that a host may have any number of rows.
    """
    return report_texts(**parts).withColumn("body", F.parse_json("body"))


def _own_folder(folder: str, assessment: str) -> str:
    if not assessment or "/" in assessment or assessment.startswith("."):
        raise ValueError("an assessment's name is one part of a path")
    return f"{folder}/assessment={assessment}"


def write_rows(rows: DataFrame, folder: str, assessment: str, per_file: int = ROWS, keep: Callable[[DataFrame], DataFrame] | None = stored) -> None:
    """SNK-01: the rows of one assessment as JSON lines (gzip), in ranges of host, part and place, ``per_file`` rows to a file. Written again it replaces itself, and nothing else.

    Rows are read three times and so kept before, by ``keep``; None is for rows that are kept already. ``body`` is a VARIANT or JSON text.
    """
    body = F.col("body") if dict(rows.dtypes)["body"] == "string" else F.to_json("body")
    head = F.to_json(F.struct(*ORDER))
    texts = rows.select(*ORDER, F.concat(F.left(head, F.length(head) - 1), F.lit(',"body":'), F.coalesce(body, F.lit("null")), F.lit("}")).alias("value"))
    lines = texts if keep is None else keep(texts)
    files = max(1, -(-lines.count() // per_file))
    with shuffles_dropped(rows.sparkSession):
        lines.repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER).select("value").write.mode("overwrite").option("compression", "gzip").text(_own_folder(folder, assessment))
    if keep is stored:
        drop_stored(lines)


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(host_id, part, place, body, assessment) of all that ``write_rows`` wrote; bodies are JSON."""
    return spark.read.schema(REPORT_ROW).json(folder)


def reports(findings: DataFrame, summary: DataFrame, limitations: DataFrame) -> DataFrame:
    """One nested row per host: its summary, ordered findings with redacted attributes, and limitations. For hosts whose report fits one row; ``report_rows`` has no such bound."""
    findings = _redacted(findings)
    cols = [c for c in findings.columns if c != "host_id"]
    listed = findings.groupBy("host_id").agg(F.array_sort(F.collect_list(F.struct("place", *[c for c in cols if c != "place"])), lambda a, b: a["place"] - b["place"]).alias("findings"))
    texts = limitations.groupBy("host_id").agg(F.array_sort(F.collect_list("limitation")).alias("limitations"))
    totals = summary.select("host_id", F.struct(*[c for c in summary.columns if c != "host_id"]).alias("summary"))
    return totals.join(listed, "host_id", "left").join(texts, "host_id", "left")


def write_reports(reports: DataFrame, folder: str, assessment: str, per_file: int = DOCUMENTS) -> None:
    """A JSON report per line, ``per_file`` reports to a file. Written again it replaces the same assessment, and nothing else."""
    files = max(1, -(-reports.count() // per_file))
    reports.repartition(files, "host_id").write.mode("overwrite").json(_own_folder(folder, assessment))


def write_table(df: DataFrame, folder: str, collected_date: Column, assessment: str) -> None:
    """SNK-02: Parquet, partitioned by the day of collection and the assessment. Written again it replaces its own partitions."""
    _own_folder(folder, assessment)
    dated = df.withColumns({"collected_date": F.to_date(collected_date), "assessment": F.lit(assessment)})
    dated.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **DIGESTS_PLAIN).partitionBy("collected_date", "assessment").parquet(folder)


def write_updates(df: DataFrame, batch: int, folder: str) -> None:
    """What one batch of a stream in update mode tells; for ``foreachBatch``. A batch that is run again writes over what it wrote, so that it counts once."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").options(compression="zstd", **DIGESTS_PLAIN).parquet(f"{folder}/batch={batch:010}")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last told row of each value of ``keys``, of what ``write_updates`` wrote."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
