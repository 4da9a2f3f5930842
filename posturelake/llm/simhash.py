"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints that differ in at most ``limit`` bits are linked. The upper nodes of the index stand for shared bit patterns under a mask: the bits are cut
into ``limit`` + 1 parts, of which two linked fingerprints have at least one in common, and a mask takes as many bits of a part as bring a node to some SHARED
fingerprints. So each fingerprint goes to one node for each part, and whole nodes that differ there are pruned without a look. A node that holds over NODE_ROWS is cut again by the bits that are still free. Below, a
node's fingerprints are sorted by Gray rank, so that neighbours share many bits; lower nodes stand for consecutive fingerprints (or nodes) and hold the
bits on which all of them agree. A search goes down, adds up the differences on the bits that a node shares beyond its parent, and leaves a node with all
that it holds once the sum is over the limit.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.lineage import cut
from .common import LOWER, UPPER, map_batches, map_texts, nested, sized

SEED = 42
FANOUT = 8
#: Fingerprints that an upper node holds on average at most, and at all; larger ones are cut again.
SHARED, NODE_ROWS = 1024, 4096
_QUERIES = 1024  # searched at once
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of the text's word shingles; 0 without a word."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    last = ends[width - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 15
    for i in range(0, len(last), step):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[i : i + step], last[i : i + step])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(last)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, digest: Column | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long; with a third column ``digest``, if it is given."""
    more = {} if digest is None else {"digest": digest}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[x.alias(n) for n, x in more.items()])
    return map_texts(rows, each, "doc_id long, fp long" + ", digest long" * len(more))


def gray_rank(fp: Column) -> Column:
    """Place of a code in Gray order, with its top bit flipped so that signed longs sort as unsigned ones."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def _ranks(fp: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(shift))
    return fp


class GrayIndex:
    """Levels of nodes over codes in Gray order; ``low``/``high`` are the AND and OR of what a node holds."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        levels = [(low, high)]
        while len(levels[-1][0]) > FANOUT:
            cuts = np.arange(0, len(levels[-1][0]), FANOUT)
            levels.append((np.bitwise_and.reduceat(levels[-1][0], cuts), np.bitwise_or.reduceat(levels[-1][1], cuts)))
        self.levels = []  # from the top: the bits shared by a node's codes beyond its parent's, and their values
        above = np.zeros(1, np.uint64)
        for n, (lo, hi) in enumerate(reversed(levels)):
            shared = ~(lo ^ hi)
            parent = above[np.arange(len(lo)) // FANOUT] if n else np.zeros(len(lo), np.uint64)
            self.levels.append((shared & ~parent, lo))
            above = shared

    def search(self, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (code's place, lowest node's place) whose shared bits differ in at most ``limit`` places."""
        who, node, far = np.repeat(np.arange(len(codes)), len(self.levels[0][0])), np.tile(np.arange(len(self.levels[0][0])), len(codes)), 0
        for n, (shared, value) in enumerate(self.levels):
            if n:
                first, size = node * FANOUT, len(value)
                count = np.minimum(FANOUT, size - first)
                keep = np.arange(FANOUT) < count[:, None]
                who, far = (np.repeat(x, FANOUT)[keep.ravel()] for x in (who, far))
                node = (first[:, None] + np.arange(FANOUT)).ravel()[keep.ravel()]
            far = far + np.bitwise_count((codes[who] ^ value[node]) & shared[node]).astype(np.int64)
            near = far <= limit
            who, node, far = who[near], node[near], far[near]
        return who, node


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star from each least node that links the same nodes as the given pairs."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = ends[: len(a)], ends[len(a) :], np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            moved = root != np.arange(len(names))
            return names[moved], names[root[moved]]


def _parts(mask: int, limit: int) -> list[int]:
    """The bits outside ``mask``, cut into ``limit`` + 1 masks of nearly equal size, from the top."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    edges = [len(free) * k // (limit + 1) for k in range(limit + 2)]
    return [sum(1 << b for b in free[s:e]) for s, e in zip(edges, edges[1:])]


def _top(mask: int, n: int) -> int:
    """The upper ``n`` bits of a mask, or all."""
    return sum(1 << b for b in [b for b in range(63, -1, -1) if mask >> b & 1][:n])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def upper_nodes(codes: DataFrame, limit: int = 2) -> DataFrame:
    """(mask, value, fp, node): the codes of each upper node, which agree in ``value`` on the bits of ``mask``.

    The first masks take of each part the least number of bits that leaves a node SHARED codes if bits were even; none, and so one node for all, while there are no more. Two codes that differ in at most ``limit`` bits meet in a node. A node of over NODE_ROWS codes takes the whole part, then is cut by the bits outside its mask. Since codes are distinct, a node holds at most
    two to the number of its free bits, of which each cut leaves about two thirds, so that the rounds are few whatever the codes are.
    """
    spark, ready, cut_by = codes.sparkSession, [], lambda m: [_signed(m | p) for p in _parts(m, limit)]
    bits = max(0, math.ceil(math.log2(max(1, codes.count()) / SHARED)))
    refine: dict[int, list[int]] = {}  # by a first mask the whole parts that it takes bits of: two codes that agree on no more of one meet under another
    for p in _parts(0, limit):
        refine.setdefault(_top(p, bits), []).append(p)
    first = sorted(map(_signed, refine))
    rows, masks = codes.select(F.array(*[F.lit(x).cast("long") for x in first]).alias("finer"), "fp", "node"), [0]
    while masks:
        rows = rows.select(F.explode("finer").alias("mask"), "fp", "node")
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        full = sized(cut(rows.groupBy("mask", "value").agg(F.count("*").alias("held")).where(F.col("held") > NODE_ROWS).select("mask", "value")))
        masks = [r[0] & (1 << 64) - 1 for r in full.select("mask").distinct().collect()]  # as many as there are ways to cut, whatever the codes are
        if masks:
            rows = cut(rows)
        ready.append(rows.join(full, ["mask", "value"], "left_anti") if masks else rows)
        if masks:
            finer = spark.createDataFrame([(_signed(m), list(map(_signed, refine[m])) if refine.get(m, [m]) != [m] else cut_by(m)) for m in masks], "mask long, finer array<long>")
            rows = rows.join(full, ["mask", "value"], "left_semi").drop("value").join(F.broadcast(finer), "mask")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out.select("mask", "value", "fp", "node")


def _near(fp: np.ndarray, node: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning stars of the pairs within ``limit`` bits in each upper node; nodes begin at ``starts`` and lie in Gray order."""
    sizes = np.diff(np.append(starts, len(fp)))
    upper = np.repeat(np.arange(len(starts)), sizes)
    leaf = np.repeat(sizes <= FANOUT, sizes)  # a lowest node and no more
    for d in range(1, min(FANOUT, int(sizes.max(initial=0)))):
        at = np.flatnonzero((upper[d:] == upper[:-d]) & leaf[d:])
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= limit]
        if len(at):
            yield _forest(node[at], node[at + d])
    for s, n in zip(starts[sizes > FANOUT].tolist(), sizes[sizes > FANOUT].tolist()):
        codes, names = fp[s : s + n], node[s : s + n]
        index = GrayIndex(codes, codes)
        for i in range(0, n, _QUERIES):
            who, found = index.search(codes[i : i + _QUERIES], limit)
            later = found > who + i  # each pair once
            if later.any():
                yield _forest(names[who[later] + i], names[found[later]])


def links(codes: DataFrame, limit: int = 2) -> DataFrame:
    """(src, dst) edges that join the same nodes as all pairs of codes within ``limit`` bits.

    ``codes`` has distinct ``fp`` and their ``node``. An upper node reports a spanning star of what it found
    rather than each pair, so that dense groups of near copies stay linear.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(4)]  # the rows of the last upper node, which may go on
        for b in itertools.chain(batches, [None]):
            cols = held if b is None else [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            mask, value, fp, node = cols
            if not len(fp):
                continue
            starts = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1])
            end = len(fp) if b is None else int(starts[-1])
            held = [c[end:] for c in cols]
            for src, dst in _near(fp[:end].view(np.uint64), node[:end], starts[starts < end], limit):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    dealt = upper_nodes(codes, limit).repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("fp")))
    return map_batches(dealt, find, "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` the least id that can be reached by links of
    at most ``limit`` differing bits. Equal fingerprints are searched for once and stand under the least id that has them, so a
    large group of exact copies costs one search. Null and empty texts have fingerprint zero and link like others. Repeated rows
    each get their row. A null id gets its class's component, and null if no row of its fingerprint has an id. Texts of any length are read
    whole, and columns beyond id and text are not looked at. An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    codes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(links(codes.where("node IS NOT NULL"), limit))
    classes = codes.join(roots, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group of near copies; one of rows that share an id and a group. Null ids stay.

    Groups are made of fingerprints alone: texts that only share an id are not near copies, and each stays unless its own group has a lesser id.
    Of one id's several texts in a group the one of least hash stays; of repeated rows one stays. Null and empty texts are one group. All columns
    come back, of any name; an empty table gives an empty one.
    """
    digest = lambda: F.xxhash64(F.col(text_col).cast("string"))
    prints = cut(fingerprints(docs, id_col, text_col, digest=digest()).where("doc_id IS NOT NULL"))
    codes = cut(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("least")))
    roots = components(links(codes.select("fp", F.col("fp").alias("node")), limit))
    least = codes.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp")).agg(F.min("least").alias("least"))
    stay = cut(least.select(F.col("least.doc_id").alias("kept_id"), F.col("least.digest").alias("kept_digest")).distinct())
    rows = nested(docs, own_id=F.col(id_col).cast("long"), own_digest=digest())
    kept = rows.where("own_id IS NOT NULL").join(stay, (F.col("own_id") == F.col("kept_id")) & (F.col("own_digest") == F.col("kept_digest")), "left_semi")
    if not prints.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["own_id", "own_digest"])
    return kept.unionByName(rows.where("own_id IS NULL")).select("doc.*")
