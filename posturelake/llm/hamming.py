"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments of 8 bits, each with a table from value to rows. A search takes up one segment after another and lets its radius grow:
once the segments up to j have been probed with radius s and the later ones with s - 1, every code within segments * s + j bits has been
met. It ends when that many bits cover the k-th distance verified so far.

The rows are dealt to blocks of bounded size, each with its own tables, and the queries in slices to every block; only the k best of a slice's
query in a block leave the task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches

BLOCK = 1 << 16  # rows of a block
SLICE = 256  # queries of a slice at least
SPREAD = 64  # pairs of block and slice to aim for: with few blocks the queries are split too, with many each block sees them all
#: Masks of a segment by the bits that they change.
MASKS = [np.array([sum(1 << i for i in c) for c in itertools.combinations(range(8), s)]) for s in range(9)]


def codes(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, code): a bit for each component, set if it is above zero. Shorter vectors are filled up with zeros; null ones have no code."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            size = np.diff(v.offsets.to_numpy())
            bits = np.zeros((b.num_rows, -(-dims // 64) * 64), bool)
            bits[np.repeat(np.arange(b.num_rows), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.nan_to_num(v.flatten().to_numpy(zero_copy_only=False)) > 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], ["id", "code"])

    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    return map_batches(known, each, "id long, code binary")


class SegmentIndex:
    """Tables from the value of each 8-bit segment to rows."""

    def __init__(self, ids: np.ndarray, code: np.ndarray):
        self.ids, self.code, self.words = ids, code, code.view(np.uint64)
        self.segments = code.shape[1]
        self.order = [np.argsort(code[:, j], kind="stable") for j in range(self.segments)]
        self.edge = [np.searchsorted(code[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def search(self, own: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest rows of another id, by distance and id."""
        words, seen = code.view(np.uint64), self.ids == own
        found, far = [], []
        count = np.zeros(8 * self.segments + 1, np.int64)
        open_ = int((~seen).sum())
        for radius in range(9):
            for j in range(self.segments):
                values = MASKS[radius] ^ code[j]
                order, edge = self.order[j], self.edge[j]
                rows = np.concatenate([order[edge[v] : edge[v + 1]] for v in values])
                rows = rows[~seen[rows]]
                seen[rows] = True
                d = np.bitwise_count(self.words[rows] ^ words).sum(axis=1, dtype=np.int64)
                found.append(rows), far.append(d)
                count += np.bincount(d, minlength=len(count))
                if count[: self.segments * radius + j + 1].sum() >= min(k, open_):
                    rows, d = np.concatenate(found), np.concatenate(far)
                    best = np.lexsort((self.ids[rows], d))[:k]
                    return d[best], self.ids[rows[best]]
        raise AssertionError("radius 8 covers every code")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k rows of ``vectors`` nearest to each row of ``queries``, by Hamming distance and then id.

    Rows that share the query's id are no neighbours of it; rows that repeat another id each count.
    Equal queries are answered once. Null vectors and null ids take no part. Fewer than k rows
    give as many neighbours as there are.
    """
    dims, n = vectors.agg(F.max(F.size(vector_col)), F.count("*")).first()
    dims = max(1, dims or 1, queries.agg(F.max(F.size(vector_col))).first()[0] or 1)
    blocks = max(1, math.ceil(n / BLOCK))
    slices = max(1, min(math.ceil(queries.count() / SLICE), math.ceil(SPREAD / blocks)))
    index = codes(vectors, id_col, vector_col, dims).withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "role": F.lit(0), "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})
    asked = codes(queries, id_col, vector_col, dims).distinct().withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "role": F.lit(1), "slice": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(slices)).cast("int")})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = None, [], None
        for b in batches:
            place = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            role, ids = b.column(2).to_numpy(), b.column(3).to_numpy()
            code = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            out: list[tuple] = []
            edges = [0, *(i for i in range(1, b.num_rows) if place[i] != place[i - 1] or role[i] != role[i - 1]), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if place[s] != at:
                    at, held, built = place[s], [], None
                if not role[s]:
                    held.append((ids[s:e], code[s:e]))
                    continue
                if built is None and held:
                    built = SegmentIndex(*(np.ascontiguousarray(np.concatenate(x)) for x in zip(*held)))
                for i in range(s, e) if built else ():
                    d, near = built.search(ids[i], np.ascontiguousarray(code[i]), k)
                    out += zip([int(ids[i])] * len(d), near.tolist(), d.tolist(), [code[i].tobytes()] * len(d))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["query_id", "neighbour_id", "distance", "query_code"])

    cols = ["block", "slice", "role", "id", "code"]
    both = index.select(cols).union(asked.select(cols)).repartition(F.col("block"), F.col("slice")).sortWithinPartitions("block", "slice", "role")
    near = map_batches(both, each, "query_id long, neighbour_id long, distance long, query_code binary")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_code").orderBy("distance", "neighbour_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
WITH codes AS (
  SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END)) AS UBIGINT) AS code FROM embeddings
), far AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(bit_count(xor(q.code, c.code)) AS BIGINT) AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance
FROM far QUALIFY rank <= 10
"""
