"""Gapless numbers, running totals and values carried forward over an order, without sending all rows of a group through one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of one chunk of a running total; a table of at most so many rows is summed in one task.
CHUNK = 4096
_AT_BITS = 33  # monotonically_increasing_id(): partition above, row of the partition below


def number_rows(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), out: str = "slot", keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... by ``order``, anew for each value of the columns ``within``.

    One range shuffle and a sort; each partition then holds consecutive rows, so that only the sizes of
    its runs (a row for each partition and value it touches) are needed to place it among the others.
    Rows that tie in ``order`` get different numbers. The result is checkpointed, or kept by ``keep``.
    """
    keys = [F.col(c) for c in within]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = keep(dealt.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__part": F.shiftright("__at", _AT_BITS), "__at": F.col("__at").bitwiseAND((1 << _AT_BITS) - 1)})
    runs = placed.groupBy("__part", *within).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__skip", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    runs = runs.select(F.col("__part").alias("__run_part"), *[F.col(c).alias(f"__run_{c}") for c in within], "__first", "__skip")
    same = F.col("__part") == F.col("__run_part")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__run_{c}"))
    joined = placed.join(runs, same).withColumn(out, F.col("__at") - F.col("__first") + F.col("__skip"))
    return joined.drop("__at", "__part", "__first", "__skip", "__run_part", *[f"__run_{c}" for c in within])


def carried(df: DataFrame, order: Sequence[Column], within: Sequence[str], last: dict[str, Column] | None = None, before: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> DataFrame:
    """Add columns that look back over all earlier rows of a group, a group of any size being many tasks' work.

    ``last``: the last value that isn't null up to this row; ``before``: up to the row before; ``total``: the sum up to this row. Groups are the
    values of ``within``, rows go by ``order``, which tells those of a group apart. Rows are dealt by range; each partition looks back by itself, and what it hands
    on is a row for each group that it touches. The result is checkpointed before that.
    """
    last, before, total = last or {}, before or {}, total or {}
    made = {f"__{k}": x for k, x in (last | before | total).items()}
    keys = [F.col(c) for c in within]
    dealt = df.withColumns(made).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", _AT_BITS))
    handed = placed.groupBy("__part", *within).agg(
        *[F.max_by(f"__{k}", F.when(F.col(f"__{k}").isNotNull(), F.col("__at"))).alias(k) for k in (*last, *before)], *[F.sum(f"__{k}").alias(k) for k in total]
    )
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of a group
    handed = handed.select(F.col("__part").alias("__run_part"), *[F.col(c).alias(f"__run_{c}") for c in within], *[F.last(k, True).over(earlier).alias(f"__from_{k}") for k in (*last, *before)], *[F.sum(k).over(earlier).alias(f"__from_{k}") for k in total])
    same = F.col("__part") == F.col("__run_part")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__run_{c}"))
    here = Window.partitionBy("__part", *within).orderBy("__at")
    upto, prior = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    found = {k: F.last(f"__{k}", True).over(upto) for k in last} | {k: F.last(f"__{k}", True).over(prior) for k in before} | {k: F.sum(f"__{k}").over(upto) for k in total}
    looked = placed.withColumns(found).join(handed, same)
    looked = looked.withColumns({k: F.coalesce(k, f"__from_{k}") for k in (*last, *before)} | {k: F.col(k) + F.coalesce(f"__from_{k}", F.lit(0)) for k in total})
    return looked.drop(*made, "__at", "__part", "__run_part", *[f"__run_{c}" for c in within], *[f"__from_{k}" for k in (*last, *before, *total)])


def running_total(df: DataFrame, number: str, value: str, rows: int, out: str = "total") -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows numbered up to this one.

    ``number`` is gapless from 0 and ``rows`` is the count of rows. Chunks of CHUNK rows are summed by
    themselves, then their totals in the same way.
    """
    if rows <= CHUNK:
        return df.withColumn(out, F.sum(value).over(Window.orderBy(number)))
    chunked = df.withColumn("__chunk", F.expr(f"`{number}` div {CHUNK}"))
    inner = chunked.withColumn("__inner", F.sum(value).over(Window.partitionBy("__chunk").orderBy(number)))
    sums = chunked.groupBy("__chunk").agg(F.sum(value).alias("__sum"))
    outer = running_total(sums, "__chunk", "__sum", -(-rows // CHUNK), "__upto")
    outer = outer.select("__chunk", (F.col("__upto") - F.col("__sum")).alias("__before"))
    return inner.join(outer, "__chunk").withColumn(out, F.col("__inner") + F.col("__before")).drop("__chunk", "__inner", "__before")
