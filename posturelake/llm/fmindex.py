"""Benchmark passages in documents, found by an FM-index over the words of each training shard.

A shard is a run of documents of one partition, some four million bytes. Its words are numbered by the shard's own vocabulary, a separator
ends each document, and the suffixes of this sequence are sorted by doubling. What is kept is the Burrows-Wheeler transform as a wavelet tree with
ranks by population counts, the vocabulary, and the suffix positions at every STEP-th place. The index knows nothing of the benchmark, is written as a table,
and can be asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_folder, cut
from ..plans.numbering import number_rows
from .common import drop_folder, lower_ascii, map_batches

SHARD_BYTES = 1 << 22  # text of a shard; a longer document is a shard of its own
STEP = 8  # every STEP-th position of the text has its suffix kept
BLOCK = 1 << 18  # windows that are broadcast at a time
LOCATE = 1 << 20  # occurrences that walk at a time
WINDOW = 10
#: Words of the contract: digits, letters and everything beyond ASCII, after A-Z were lower-cased.
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 0 for b in range(256))

_INDEX = "shard long, doc_ids array<long>, digests array<long>, sizes array<int>, copy_of array<int>, n long, vocabulary binary, lengths binary, starts binary, tree binary, kept binary, samples binary"
_HITS = "shard long, place int, doc_id long, digest long, n_words long, spans array<struct<begin:int,end:int>>, windows array<long>"


def split_words(texts: pa.LargeBinaryArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, one after another, as numbers into a vocabulary, and how many each text has. Texts are not null."""
    edge = texts.buffers()[1]
    edge = np.frombuffer(edge, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(bytes(data[int(edge[0]) : int(edge[-1])] if data else b"").translate(_WORD_BYTES), np.uint8)
    edge = edge - edge[0]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = raw != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = edge[:-1][edge[1:] > edge[:-1]]  # a text starts and ends a word, whatever its neighbours hold
    opens[full] = inside[full]
    closes[full[1:] - 1] = inside[full[1:] - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside[:-1]])])
    return words.dictionary_encode(), np.diff(np.searchsorted(begin, edge))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of ``symbols`` in the order of the suffixes there. Zeros differ from each other, by place.

    Places are ranked by their first symbols, as many as fit 63 bits, then by twice as many in each round, where only those that still tie are sorted.
    """
    n = len(symbols)
    zero = symbols == 0
    zeros = int(zero.sum())
    rank = symbols.astype(np.int64) + (zeros - 1)
    rank[zero] = np.arange(zeros)
    bits = max(1, int(rank.max(initial=0)).bit_length())
    seen = max(1, min(63 // bits, n))
    key = rank.copy()
    for j in range(1, seen):
        key <<= bits
        key[:-j] |= rank[j:]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_):  # a sequence ends in a zero, so that no two suffixes tie for good
        at = order[open_]
        key = rank[at] << 32 | rank[np.minimum(at + seen, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(open_)))
        rank[at] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        seen *= 2
    return order


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bits in words of 64, with a word to spare, so that ranks at the end need no test."""
    out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


class Ranks:
    """How many bits are set before a place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Symbols level by level, from the highest bit: within a level, symbols that share the bits above lie together, those with a zero first."""

    def __init__(self, levels: np.ndarray, n: int, first: np.ndarray):
        """first: for each symbol, the place before which the last level has all smaller ones (in the order of their reversed bits)."""
        self.ranks = [Ranks(w) for w in levels]
        self.zeros = [n - int(r.rank(np.array([n]))[0]) for r in self.ranks]
        self.first, self.depth = first, len(levels)

    @staticmethod
    def build(symbols: np.ndarray, depth: int) -> np.ndarray:
        levels = []
        for level in range(depth - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            levels.append(_pack(one))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        return np.stack(levels)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        for k, (r, zeros) in enumerate(zip(self.ranks, self.zeros)):
            ones = r.rank(at)
            at = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, at - ones)
        return at - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for r, zeros in zip(self.ranks, self.zeros):
            one, ones = r.bit(at), r.rank(at)
            symbol = symbol << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


def _first_places(counts: np.ndarray, depth: int) -> np.ndarray:
    """Where each symbol starts on the last level, whose order is that of reversed bits."""
    symbols = np.arange(len(counts))
    turned = np.zeros(len(counts), np.int64)
    for k in range(depth):
        turned |= (symbols >> k & 1) << (depth - 1 - k)
    order = np.argsort(turned)
    out = np.empty(len(counts), np.int64)
    out[order] = np.cumsum(counts[order]) - counts[order]
    return out


class FMIndex:
    """Searches one row of an index table."""

    def __init__(self, row: dict):
        ints = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
        self.n, self.starts = row["n"], ints("starts")
        counts = np.diff(self.starts)
        depth = max(1, (len(counts) - 1).bit_length())
        self.tree = WaveletTree(ints("tree", np.uint64).reshape(depth, -1), self.n, _first_places(counts, depth))
        self.kept, self.samples = Ranks(ints("kept", np.uint64)), ints("samples", np.int32)
        offsets = np.concatenate(([0], np.cumsum(ints("lengths", np.int32), dtype=np.int64)))
        self.vocabulary = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(row["vocabulary"])])

    def symbols(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """The shard's number of each word, or -1."""
        found = pc.index_in(words, value_set=self.vocabulary) if len(self.vocabulary) else pa.nulls(len(words), pa.int32())
        return found.fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted suffixes that start with each phrase, as [low, high). Phrases are right-aligned symbols; below -1 is no word, -1 a word that the shard does not have."""
        last = phrases[:, -1]
        known = (phrases != -1).all(axis=1)
        low, high = np.where(known, self.starts[last], 0), np.where(known, self.starts[last + 1], 0)
        for column in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero((high > low) & (phrases[:, column] >= 0))
            if len(live):
                symbol = phrases[live, column]
                both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
                low[live], high[live] = self.starts[symbol] + both[: len(live)], self.starts[symbol] + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row: back from word to word until one whose place was kept."""
        out = np.empty(len(rows), np.int64)
        for chunk in range(0, len(rows), LOCATE):
            at, who, steps = rows[chunk : chunk + LOCATE], np.arange(chunk, min(chunk + LOCATE, len(rows))), 0
            while len(at):
                here = self.kept.bit(at)
                out[who[here]] = self.samples[self.kept.rank(at[here])] + steps
                symbol, before = self.tree.access(at[~here])
                at, who, steps = self.starts[symbol] + before, who[~here], steps + 1
        return out


def index_shard(ids: pa.Array, digests: pa.Array, texts: pa.LargeBinaryArray) -> dict:
    """The index of one shard but for its number. Texts that are equal are indexed once."""
    coded = texts.dictionary_encode()
    copy_of, texts = coded.indices.to_numpy(), coded.dictionary
    words, sizes = split_words(texts)
    n = len(words) + len(texts)
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(n, np.int64)
    symbols[np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)] = words.indices.to_numpy() + 1
    order = suffix_array(symbols)
    counts = np.bincount(symbols, minlength=len(words.dictionary) + 1)
    depth = max(1, (len(counts) - 1).bit_length())
    keep = np.zeros(n, bool)
    keep[::STEP] = True
    keep[ends - sizes - 1] = True  # the first word of a text, so that no walk crosses a separator
    kept = keep[order]
    vocabulary = words.dictionary
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int64)[: len(vocabulary) + 1]
    return {
        "doc_ids": ids.to_pylist(), "digests": digests.to_pylist(), "sizes": sizes.astype(np.int32), "copy_of": copy_of, "n": n, "vocabulary": bytes(vocabulary.buffers()[2] or b"")[: int(offsets[-1])] if len(vocabulary) else b"",
        "lengths": np.diff(offsets).astype(np.int32).tobytes() if len(vocabulary) else b"", "starts": np.concatenate(([0], np.cumsum(counts))).tobytes(),
        "tree": WaveletTree.build(symbols[order - 1].astype(np.int32), depth).tobytes(), "kept": _pack(kept).tobytes(), "samples": order[kept].astype(np.int32).tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per shard. Documents are indexed by the task that reads them, without a shuffle; null texts are empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("copy_of", pa.list_(pa.int32())), ("n", pa.int64())] + [(c, pa.binary()) for c in ("vocabulary", "lengths", "starts", "tree", "kept", "samples")])
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            found = {"shard": shard} | index_shard(*(pa.concat_arrays(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array([found[c]], kind) for c, kind in zip(schema.names, schema.types)], schema=schema)

        for b in batches:
            ids, digests, texts = b.column(0), b.column(1), b.column(2).cast(pa.large_binary())
            total = np.cumsum(pc.binary_length(texts).to_numpy())
            begin = 0
            while begin < b.num_rows:
                done = int(total[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, done + SHARD_BYTES - size, "right")))
                held.append(tuple(x.slice(begin, end - begin) for x in (ids, digests, texts)))
                size, begin = size + int(total[end - 1]) - done, end
                if begin < b.num_rows or size >= SHARD_BYTES:
                    yield row()
                    shard, held, size = shard + 1, [], 0
        if held:
            yield row()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return map_batches(rows, each, _INDEX)


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document without overlaps; spans that touch become one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    reach = np.maximum.accumulate(doc << 32 | end)
    new = np.concatenate(([True], (doc[1:] << 32 | begin[1:]) > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], begin[first], reach[last] & 0xFFFFFFFF


def search_index(index: DataFrame, phrases: list[list[str]], number: int, every_document: bool) -> DataFrame:
    """Rows of documents that hold any of ``phrases``, whose first has ``number``; or of all documents."""
    vocabulary = sorted({w.encode() for p in phrases for w in p})
    place = {w: i for i, w in enumerate(vocabulary)}
    grid = np.full((len(phrases), max(map(len, phrases), default=1)), -2, np.int64)  # right-aligned
    for row, p in zip(grid, phrases):
        row[len(row) - len(p) :] = [place[w.encode()] for w in p]
    length = (grid >= 0).sum(axis=1)
    sent = index.sparkSession.sparkContext.broadcast((vocabulary, grid, length))  # at most BLOCK phrases

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, grid, length = sent.value
        words = pa.array(vocabulary, pa.large_binary())
        span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            sizes, copy_of = np.array(row["sizes"], np.int64), np.array(row["copy_of"], np.int64)
            begins = np.cumsum(sizes + 1) - sizes - 1
            spans, found = {}, {}
            if len(grid) and len(sizes):
                fm = FMIndex(row)
                low, high = fm.search(np.where(grid >= 0, np.append(fm.symbols(words), -2)[grid], -2))
                count = high - low
                which = np.repeat(np.arange(len(grid)), count)
                at = fm.locate(np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(which)))
                doc = np.searchsorted(begins, at, "right") - 1
                if len(at):
                    begin = at - begins[doc]
                    for d, s, e in zip(*(x.tolist() for x in _merged(doc, begin, begin + length[which]))):
                        spans.setdefault(d, []).append({"begin": s, "end": e})
                    for pair in np.unique(doc << 32 | which).tolist():
                        found.setdefault(pair >> 32, []).append(number + (pair & 0xFFFFFFFF))
            rows = [k for k, d in enumerate(copy_of.tolist()) if every_document or d in spans]
            docs = [int(copy_of[k]) for k in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array([row["doc_ids"][k] for k in rows], pa.int64()), pa.array([row["digests"][k] for k in rows], pa.int64()), pa.array(sizes[docs], pa.int64()),
                    pa.array([spans.get(d, []) for d in docs], pa.list_(span)), pa.array([found.get(d, []) for d in docs], pa.list_(pa.int64())),
                ],
                ["shard", "place", "doc_id", "digest", "n_words", "spans", "windows"],
            )

    return map_batches(index, each, _HITS)


def bench_words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(BENCH_WORD), F.lit(0))


def _windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(item_id, w) and (w, words): the windows of the items, and each distinct one by its number."""
    words = items.select("item_id", bench_words(F.col("text")).alias("words")).where("size(words) > 0")
    begins = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    pairs = words.select("item_id", F.explode(F.transform(begins, lambda i: F.array_join(F.slice("words", i, size), " "))).alias("window")).distinct()
    windows = number_rows(pairs.select("window").distinct(), [F.col("window")], out="w")
    return pairs.join(windows, "window").select("item_id", "w"), windows.select("w", F.split("window", " ").alias("words"))


def find_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, place, doc_id, digest, n_words, spans, windows) of each document, one row or more: its spans within a block of windows and the numbers found. ``windows``: (w, words), w gapless from 0."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/fmindex-{uuid.uuid4().hex}"
    build_index(docs, id_col, text_col).write.parquet(folder)
    index, total = spark.read.schema(_INDEX).parquet(folder), windows.count()
    hits = None
    for number in range(0, max(total, 1), BLOCK):
        block = [r["words"] for r in windows.where(F.col("w").between(number, number + BLOCK - 1)).orderBy("w").collect()]
        more = search_index(index, block, number, not number)
        hits = more if hits is None else hits.union(more)
    hits = cut(hits)
    drop_folder(spark, folder)
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, digest) of each row of ``docs``; the digest is XXH64 of its text.

    A window is ``size`` consecutive words of an item, or all words of an item that has fewer but any. Words within any occurrence of a window are hit; ``spans`` are the
    runs of hit words, [begin, end) counted in words. ``n_items`` counts the distinct item ids with a window in the document; ``items_sha256`` is of these ids, sorted as strings.

    Null and empty texts have no words; an item of null id has windows that hit but counts as no item. Rows that repeat an id, or have none, each get their row. Equal windows are searched once, whatever items
    they come from, and documents that hold the same windows share one list of items, so that copies on both sides make no pairs. Texts
    are indexed whole, one of any length in a shard of its own. Empty tables give no rows, or no hits. Only the named columns are read, so that others may have any name.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    pairs, windows = _windows(items, size)
    hits = find_windows(docs, windows, id_col, text_col)
    at = Window.partitionBy("shard", "place").orderBy("begin", "end")
    spans = hits.select("shard", "place", F.inline("spans")).withColumn("reach", F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("begin") <= F.col("reach"), 0).otherwise(1)).over(at))
    spans = spans.groupBy("shard", "place", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = spans.groupBy("shard", "place").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    rows = hits.groupBy("shard", "place").agg(F.max("doc_id").alias("doc_id"), F.max("digest").alias("digest"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("windows"))).alias("windows"))
    rows = rows.withColumn("held", F.when(F.size("windows") > 0, F.md5(F.array_join("windows", ","))))
    rows = cut(rows.join(spans, ["shard", "place"], "left"))
    lists = rows.where("held IS NOT NULL").groupBy("held").agg(F.first("windows").alias("windows")).select("held", F.explode("windows").alias("w"))
    lists = lists.join(pairs.where("item_id IS NOT NULL"), "w").select("held", "item_id").distinct()
    lists = lists.groupBy("held").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    zero = F.lit(0).cast("long")
    return rows.join(lists, "held", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).cast("long").alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"), F.coalesce("spans", F.expr("CAST(array() AS array<struct<begin:int,end:int>>)")).alias("spans"), "digest",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """(doc, kept, n_hit): each row as a struct, its text without the spans that ``contamination`` finds, and how many words went.

    A span goes from its first word's first character to its last word's last one; null texts stay null. Rows that share id and text are alike.
    """
    found = contamination(docs, benchmark, size, id_col, text_col, **columns).where("contaminated").select("doc_id", "digest", "n_hit", "spans").distinct()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own"))
    # words and what stands between them take turns
    parts = F.regexp_extract_all(F.col("text"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    lead = F.when(F.col("text").rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"), 0).otherwise(1)
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest")), "left").withColumns({"parts": parts, "lead": lead})
    edges = F.concat(F.array(F.struct(F.lit(0).alias("begin"), F.lit(0).alias("end"))), F.transform("spans", lambda s: F.struct((2 * s["begin"] + F.col("lead")).alias("begin"), (2 * s["end"] - 1 + F.col("lead")).alias("end"))), F.array(F.struct(F.size("parts").alias("begin"), F.lit(0).alias("end"))))
    runs = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda k: F.slice("parts", edges[k]["end"] + 1, edges[k + 1]["begin"] - edges[k]["end"]))
    kept = F.when(F.size("spans") > 0, F.array_join(F.flatten(runs), "")).otherwise(F.col("text"))
    return joined.select("doc", kept.alias("kept"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len(ws) AS n, array_to_string(ws, ' ') AS win
  FROM (SELECT item_id, unnest([w[i : i + 9] FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS ws FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hit AS (
  SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
