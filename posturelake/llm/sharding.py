"""Minimax contiguous partition of groups of equal texts into shards.

Groups are atomic and ordered. The smallest capacity is searched for with which greedy filling needs no more shards than there are; cuts go
where the greedy filling at that capacity ends a shard. No cut can help a group that outweighs a fair share, so that by rule such giants are taken out first,
the largest at a time, and each is a shard of its own behind the others; what is left is contiguous. The sizes stay in Spark as running totals: a greedy step asks, for all capacities
that a round tries, for the largest total that a shard can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.numbering import number_rows, running_total
from .common import map_batches

SHARDS = 8
#: Capacities tried in a round.
TRIES = 256


def _reach(ends: DataFrame, upto: np.ndarray) -> np.ndarray:
    """For each number the largest running total that isn't above it, or 0. At most one row per number comes to the driver."""
    order = np.unique(upto)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(order), np.int64)
        for b in batches:
            total = b.column(0).to_numpy()
            at = np.searchsorted(order, total)
            fits = at < len(order)
            np.maximum.at(best, at[fits], total[fits])
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(best)), pa.array(best[best > 0])], ["k", "total"])

    best = np.zeros(len(order), np.int64)
    for k, total in map_batches(ends.select("total").where(F.col("total") <= int(order[-1])), each, "k long, total long").groupBy("k").agg(F.max("total")).collect():
        best[k] = total
    return np.maximum.accumulate(best)[np.searchsorted(order, upto)]


def minimax_cuts(ends: DataFrame, shards: int, largest: int, whole: int) -> list[int]:
    """Running totals at which each shard ends, for the least capacity that suffices.

    ``ends`` holds the column ``total``, the running totals of the ordered groups; ``largest`` is the largest group and ``whole`` the sum.
    """
    low = max(largest, -(-whole // shards))
    high = low + largest  # filled greedily, all shards but the last then hold over whole / shards
    best: list[int] | None = None
    while best is None or low < high:
        tried = np.unique(np.linspace(low, high, TRIES).astype(np.int64))
        at, cuts = np.zeros(len(tried), np.int64), []
        for _ in range(shards):
            going = at < whole
            if going.any():
                at = np.where(going, _reach(ends, np.minimum(at + tried, whole)), whole)
            cuts.append(at)
        ok = int(np.flatnonzero(at >= whole)[0])
        best = [int(c[ok]) for c in cuts]
        high, low = int(tried[ok]), int(tried[ok - 1]) + 1 if ok else int(tried[0])
    return best


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) of every row.

    Size is the UTF-8 bytes of the text and 1. Equal texts are one group, in the order of their least id (null first); null text is empty. Giants: while the largest
    group holds at least a fair share of what is left, it gets a shard of its own, from the last but those taken, and the rest is cut into those that are
    left, contiguous in the stated order. Texts of any length count whole; an empty table gives an empty one; further columns are not looked at. Slots are gapless from
    0 in each shard, by group and id; repeated rows get slots of their own. With few groups some shards are empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"))
    rows = cut(rows)
    groups = cut(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first")))
    giants: list[tuple[int, bytes]] = []
    left, whole = shards, groups.agg(F.sum("bytes")).first()[0] or 0
    for size, grp in [(r["bytes"], bytes(r["grp"])) for r in groups.orderBy(F.desc("bytes"), "grp").limit(shards).collect()]:
        if left > 1 and size * left >= whole:
            giants.append((size, grp))
            left, whole = left - 1, whole - size
    rest = groups.where(~F.col("grp").isin([g for _, g in giants])) if giants else groups
    n, largest = rest.agg(F.count("*"), F.max("bytes")).first()
    ends = cut(running_total(number_rows(rest, [F.col("first"), F.col("grp")], out="n"), "n", "bytes", n).select("grp", "total"))
    cuts = minimax_cuts(ends.select("total"), left, largest, whole) if n else []
    number = sum([(F.col("total") > c).cast("int") for c in cuts[:-1]], F.lit(0))
    placed = ends.withColumn("shard", number)
    if giants:
        own = docs.sparkSession.createDataFrame([(bytearray(g), whole + k + 1, left + k) for k, (_, g) in enumerate(giants)], "grp binary, total long, shard int")
        placed = placed.unionByName(own)
    dealt = rows.join(placed, "grp").select("doc_id", "size", "text_crc32", "shard", "total")
    dealt = number_rows(dealt, [F.col("total"), F.col("doc_id"), F.col("text_crc32")], within=["shard"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
