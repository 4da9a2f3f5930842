"""Streaming forms: event roll-up, rules with deduplication over a stream of sockets, and successive snapshots compared as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import engine, report
from ..operators.rules import RULES, one_pass
from ..plans.lineage import drop_stored, stored
from ..sources import sinks


#: What makes two events the same one, sent twice, beside their data.
EVENT_KEY = ["execution_id", "ts", "event", "level"]


def distinct_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once each; those that differ in their data alone are different. What is behind the latest event by more than ``delay`` is late and dropped, and so is the state of keys as old."""
    whole = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("data")))) if "data" in events.columns else F.lit(None).cast("string")  # maps can't be keys
    return events.withColumn("__data", whole).withWatermark("ts", delay).dropDuplicatesWithinWatermark([*EVENT_KEY, "__data"]).drop("__data")


def rollup_stream(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """AGG-21 on a stream, in update mode: outcomes per execution and window of ``width``.

    The state of a window is dropped once the watermark has passed its end, so that it is bounded by the executions of the windows still open. Windows are merged by ``report.merge_rollups`` when
    they are read. Events that are later than ``delay`` and their window's end are dropped. Repeated events count once if the source was made ``distinct_events`` by a query of its own, since Spark chains stateful operators in append mode only.
    """
    stamped = events.withWatermark("ts", delay)
    out = report.event_rollup(stamped, F.window("ts", width).alias("window"))
    return out.select("execution_id", F.col("window.start").alias("window"), *[c for c in out.columns if c not in ("execution_id", "window")])


def session_stream(events: DataFrame, delay: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """AGG-21 by sessions on a stream of events, repeated ones counted once; append mode. State is dropped as sessions close."""
    return report.execution_sessions(distinct_events(events, delay), gap)


def socket_findings(sockets: DataFrame, catalogue: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Findings of the socket rules over a stream with ``collected_at``; a finding is told once per host within the watermark (ENG-08). A rule that asks for facts of the host beside the socket (NET-005) is none of them."""
    rules = [r for r in RULES if r.table == "sockets" and not r.beside]
    stamped = sockets.withWatermark("collected_at", delay)
    own = one_pass(stamped.withColumn("host_id", F.struct("host_id", "collected_at")), rules)
    flat = own.select("host_id.host_id", "host_id.collected_at", "rule_id", "title", "impact", "objects", "attributes")
    found = flat.join(F.broadcast(catalogue), "rule_id")  # of fixed size
    title = F.coalesce("title", "default_title")
    key = engine.fingerprint(F.col("rule_id"), F.col("category"), title, F.col("objects"), F.map_entries("attributes"))
    return found.select("host_id", "collected_at", "rule_id", title.alias("title"), key.alias("dedupe_key")).dropDuplicatesWithinWatermark(["host_id", "dedupe_key"])


def snapshot_changes(snapshots: DataFrame, keep_days: int = 90) -> DataFrame:
    """AGG-19 on a stream: (host_id, collected_at, rule_id, fingerprint, change) of (host_id, part, collected_at, items), as ``report.snapshot_rows`` makes them; append mode.

    The state of a host and part is the time and the items of its last snapshot. The next snapshot tells each of its items as new or unchanged and each that it lacks
    as resolved. A snapshot that is not later than the last one compared is late: it changes nothing and is told by a row for each part, without rule and fingerprint, change ``late``. One that is over ``keep_days`` behind the
    latest of all is dropped by the watermark, and a host that has sent none for as long is forgotten.
    """

    def compare(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, [])
        seen, out = set(seen), []
        for row in pd.concat(batches).sort_values("collected_at", kind="stable").itertuples():
            at = row.collected_at.value // 1000
            if last is not None and at <= last:
                out.append((key[0], row.collected_at, None, "late"))
                continue
            now = set(row.items)
            out += [(key[0], row.collected_at, x, "unchanged" if x in seen else "new") for x in sorted(now)]
            out += [(key[0], row.collected_at, x, "resolved") for x in sorted(seen - now)]
            last, seen = at, now
        state.update((last, sorted(seen)))
        state.setTimeoutTimestamp(max(last // 1000 + keep_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["host_id", "collected_at", "item", "change"])

    stamped = snapshots.withWatermark("collected_at", f"{keep_days} days")
    told = stamped.groupBy("host_id", "part").applyInPandasWithState(compare, "host_id long, collected_at timestamp, item string, change string", "last long, seen array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("host_id", "collected_at", F.substring_index("item", ":", 1).alias("rule_id"), F.substring_index("item", ":", -1).alias("fingerprint"), "change")


#: What names a snapshot that was sent, and a finding in it, where many hosts' snapshots are compared.
SHOT, ITEM = ("host_id", "part", "collected_at"), ("rule_id", "fingerprint")


def as_items(batch: DataFrame) -> DataFrame:
    """Snapshots as ``report.snapshot_items`` makes them, of rows with lists as well (``report.snapshot_rows``): of a snapshot that is there twice, one list counts."""
    if "items" not in batch.columns:
        return batch.select(*SHOT, *ITEM)
    nth = F.row_number().over(Window.partitionBy(*SHOT).orderBy(F.xxhash64("items")))
    listed = F.concat(F.array(F.lit(None).cast("string")), F.when((F.col("nth") == 1) & F.col("items").isNotNull(), F.array_compact("items")).otherwise(F.array().cast("array<string>")))
    rows = batch.withColumn("nth", nth).select(*SHOT, F.explode(listed).alias("item"))
    return rows.select(*SHOT, F.substring_index("item", ":", 1).alias("rule_id"), F.substring_index("item", ":", -1).alias("fingerprint"))


def compare_last(batch: DataFrame, last: DataFrame, keep_days: int = 90) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """What ``snapshot_changes`` tells of one batch of snapshots, and the last snapshot of each host and part after it, by joins and windows alone; ``last`` is what was kept before, both are as ``as_items`` makes them. The third is what
    was stored for both, to be dropped once they are written.

    For many hosts with any number of findings: no function is called host by host, and no row holds more than a finding. A snapshot that is over ``keep_days`` behind the latest one kept is dropped, and one kept that is as old is forgotten.
    """
    key, none = ["host_id", "part"], [F.lit(None).cast(kind).alias(x) for x, kind in batch.dtypes if x in ITEM]
    newest = last.agg(F.max("collected_at")).first()[0]
    recent = F.lit(True) if newest is None else F.col("collected_at") >= F.lit(newest) - F.expr(f"INTERVAL {keep_days} DAYS")
    old, new = last.where(recent).withColumn("old", F.lit(True)), batch.where(recent).withColumn("old", F.lit(False))
    was = old.where("rule_id IS NULL").select(*key, F.col("collected_at").alias("kept_at"))
    sent = new.where("rule_id IS NULL").groupBy(*SHOT).agg(F.count("*").alias("times")).join(was.groupBy(*key).agg(F.max("kept_at").alias("kept_at")), key, "left")
    sent = stored(sent.withColumn("late", F.coalesce(F.col("collected_at") <= F.col("kept_at"), F.lit(False))))
    by = Window.partitionBy(*key).orderBy("collected_at")
    shots = was.select(*key, F.col("kept_at").alias("collected_at"), F.lit(True).alias("old")).union(sent.where("NOT late").select(*SHOT, F.lit(False)))
    shots = stored(shots.withColumns({"before": F.lag("collected_at").over(by), "next": F.lead("collected_at").over(by)}))
    items = old.union(new).where("rule_id IS NOT NULL")
    changes = report.told_changes(items.join(shots, [*SHOT, "old"]), [*key, *ITEM], ~F.col("old")).select("host_id", "collected_at", *ITEM, "change")
    again = F.when(F.col("late"), F.col("times")).otherwise(F.col("times") - 1).cast("int")
    late = sent.select("host_id", "collected_at", F.explode(F.array_repeat(F.lit("late"), again)).alias("change")).select("host_id", "collected_at", *none, "change")
    kept = shots.where("next IS NULL")
    after = kept.select(*SHOT, *none).union(items.join(kept, [*SHOT, "old"], "left_semi").select(*SHOT, *ITEM))
    return changes.union(late), after, [sent, shots]


def keep_last(batch: DataFrame, number: int, out: str, kept: str, keep_days: int = 90) -> None:
    """AGG-19 on a stream of many hosts, for ``foreachBatch``: changes go to ``out`` and the last snapshots to ``kept``, in a folder of the batch, so that a batch that is run again writes over what it wrote. Of what was
    kept, that from which this batch goes on stays, and older folders are deleted. All rows of a snapshot's part come in one batch."""
    spark, jvm = batch.sparkSession, batch.sparkSession._jvm
    root = jvm.org.apache.hadoop.fs.Path(kept)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted(n for x in (files.listStatus(root) if files.exists(root) else ()) if (n := int(x.getPath().getName().split("=")[1])) < number)
    batch = stored(as_items(batch))
    last = spark.read.parquet(f"{kept}/batch={numbers[-1]:010}") if numbers else batch.where("false")
    changes, after, made = compare_last(batch, last, keep_days)
    sinks.write_updates(changes, number, out)
    sinks.write_updates(after, number, kept)
    for df in (batch, *made):
        drop_stored(df)
    for n in numbers[:-1]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{kept}/batch={n:010}"), True)
