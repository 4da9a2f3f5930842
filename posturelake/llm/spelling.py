"""Words of a corpus that differ by one letter, found by probing generated edits against Bloom filters.

The vocabulary is cut into shards by length, each with a blocked Bloom filter: a word sets BITS bits within one block of 64. Every word generates its edits as
hashes, without the strings: a polynomial hash gives that of an edit from the word's own in constant time. Edits that a filter lets through are written out and
shuffled to an exact join with the vocabulary, which takes the false positives away.

Being near is symmetric, so that each pair is generated from one side: a deletion from the longer word, a replacement from the word whose letter comes
first in LETTERS. Rare letters come first there, so that few replacements are generated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import lower_ascii, map_batches

LENGTH, TIMES, DAMAGE = 5, 3, 97
#: Letters of a word once A-Z are lower-cased; each replaces those before it.
LETTERS = bytes([*range(0xC0, 0x100), *range(ord("a"), ord("z") + 1)])
LONG = 64  # longer words share one filter
BITS = 4  # bits that a word sets in its block
BITS_PER_WORD = 24
SLICE = 1 << 22  # blocks of the filters that are broadcast at a time (8 bytes each)
CELLS = 1 << 17  # letters whose edits are generated at a time

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = np.zeros(256, np.int64)
_PLACE[list(LETTERS)] = np.arange(len(LETTERS))
_BY_PLACE = np.frombuffer(LETTERS, np.uint8).astype(np.uint64)


def runs(text: Column, length: int) -> Column:
    """Runs of letters with at least ``length`` code points, A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(rf"[a-zÀ-ÿ]{{{length},}}"), F.lit(0))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n): words of at least ``length`` code points that occur at least ``times`` times. A run whose CRC-32 with its document's id (none: empty) is a multiple of DAMAGE loses a letter."""
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col(text_col).cast("string"), length)).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % DAMAGE == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their letters as a matrix; not many letters at a time."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        step = max(1, CELLS // int(size))
        for k in range(0, len(which), step):
            some = which[k : k + step]
            yield some, np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), size)


class Filters:
    """Where words of each length have their blocks. The words are dealt by hash to ``slices`` sets of filters, of which one is in memory at a time."""

    def __init__(self, counts: dict[int, int]):
        """counts: words by length, LONG for all longer ones."""
        blocks = np.zeros(LONG + 1, np.int64)
        for length, n in counts.items():
            blocks[length] = -(-n * BITS_PER_WORD // 64)
        self.slices = max(1, -(-int(blocks.sum()) // SLICE))
        self.blocks = -(-blocks // self.slices)
        self.base = np.cumsum(self.blocks) - self.blocks
        self.size = int(self.blocks.sum())

    def place(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slice, block and bits of hashes of words of one length."""
        h = _mix(h)
        shard = min(length, LONG)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks[shard]) >> np.uint64(32)).astype(np.int64) + self.base[shard]
        bits = np.zeros(len(h), np.uint64)
        for k in range(BITS):
            bits |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
        slice_ = _mix(h) % np.uint64(self.slices) if self.slices > 1 else np.zeros(len(h), np.uint64)
        return slice_.astype(np.int32), block, bits


def _latin(words: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in words.to_pylist()]


def build_filters(words: DataFrame, filters: Filters) -> DataFrame:
    """(slice, block, bits) of all filters: each task's words first put together by themselves."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [filters.place(m.shape[1], ((m.astype(np.uint64) + np.uint64(1)) * _powers(m.shape[1])).sum(axis=1, dtype=np.uint64)) for _, m in _by_length(_latin(b.column(0)))]
            if held:
                slice_, block, bits = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_arrays([pa.array(slice_), pa.array(block), pa.array(bits.view(np.int64))], ["slice", "block", "bits"])

    return map_batches(words.select("word"), each, "slice int, block long, bits long").groupBy("slice", "block").agg(F.bit_or("bits").alias("bits"))


def _edits(m: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the edits of words of one length: the edits' length, hashes, rows, places and letters (0: deleted)."""
    n, size = m.shape
    power = _powers(size)
    term = (m.astype(np.uint64) + np.uint64(1)) * power
    whole = term.sum(axis=1, dtype=np.uint64)
    upto = np.cumsum(term, axis=1, dtype=np.uint64)
    shorter = upto - term + (whole[:, None] - upto) * np.uint64(_BACK)
    differs = np.ones(m.shape, bool)  # deleting either of two equal neighbours gives the same word
    differs[:, 1:] = m[:, 1:] != m[:, :-1]
    row, at = np.nonzero(differs)
    yield size - 1, shorter[row, at], row, at, np.zeros(len(row), np.int64)
    own = _PLACE[m].ravel()
    for k in range(0, n * size, CELLS):
        cell = own[k : k + CELLS]
        more = len(LETTERS) - 1 - cell
        who = np.repeat(np.arange(len(cell)), more)
        letter = np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more) + cell[who] + 1
        row, at = np.divmod(who + k, size)
        yield size, whole[row] + (_BY_PLACE[letter] - _BY_PLACE[cell[who]]) * power[at], row, at, np.frombuffer(LETTERS, np.uint8)[letter].astype(np.int64)


def probe(words: DataFrame, filters: Filters, sent: Broadcast, number: int, length: int) -> DataFrame:
    """(edit, word, n): edits of words of at least ``length`` code points that the filters of slice ``number`` let through."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            latin, n = _latin(b.column(0)), b.column(1).to_pylist()
            out = []
            for some, m in _by_length(latin):
                for size, h, row, at, letter in _edits(m):
                    if size < length or not len(h) or not filters.blocks[min(size, LONG)]:
                        continue
                    slice_, block, bits = filters.place(size, h)
                    hit = np.flatnonzero((slice_ == number) & (table[block] & bits == bits))
                    for i, p, c in zip(some[row[hit]].tolist(), at[hit].tolist(), letter[hit].tolist()):
                        w = latin[i]
                        out.append(((w[:p] + (bytes([c]) if c else b"") + w[p + 1 :]).decode("latin-1"), w.decode("latin-1"), n[i]))
            edit, word, count = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(edit, pa.string()), pa.array(word, pa.string()), pa.array(count, pa.int64())], ["edit", "word", "n"])

    return map_batches(words.select("word", "n"), each, "edit string, word string, n long")


def near_pairs(words: DataFrame, length: int = LENGTH) -> DataFrame:
    """(word, n, near, near_n): each pair of words that differ by one inserted, deleted or replaced code point, from both sides. ``words``: (word, n), distinct, of the letters of LETTERS."""
    counts = words.groupBy(F.least(F.char_length("word"), F.lit(LONG)).alias("size")).agg(F.count("*").alias("n")).collect()  # LONG rows at most
    filters = Filters({r["size"]: r["n"] for r in counts})
    blocks = build_filters(words, filters)
    blocks = cut(blocks) if filters.slices > 1 else blocks
    found = None
    for number in range(filters.slices):
        table = np.zeros(filters.size, np.uint64)
        some = blocks.where(F.col("slice") == number).toArrow()  # at most SLICE rows and a few
        table[some.column("block").to_numpy()] = some.column("bits").to_numpy().view(np.uint64)
        more = probe(words, filters, words.sparkSession.sparkContext.broadcast(table), number, length)
        found = more if found is None else found.union(more)
    exact = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    sides = F.array(F.struct("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return exact.select(F.inline(sides))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that following forms leads to. Each round doubles the steps taken; chains have no circles."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = cut(known.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")))
        if known.where("went").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the corpus.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF (with U+00D7 and U+00F7), only A-Z lower-cased, of which one in DAMAGE loses a letter by its CRC-32; those of at least
    ``length`` code points that occur ``times`` times or more. A word's form is its near word of largest count, ties going to the smallest in code-point order, if that
    occurs at least twice as often; the root is where forms lead, the word itself if it has none.

    Null and empty texts have no words; a null id counts as an empty one. Repeated rows count again. Texts and words of any length are taken whole: a word must fit a task. An empty table
    gives no rows. Only the named columns are read.
    """
    words = cut(vocabulary(docs, id_col, text_col, length, times))
    pairs = near_pairs(words, length)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    often = -F.col("best.less") >= 2 * F.col("n")
    near = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")))
    return near.join(roots(near.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS tagged, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), coded AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(tagged, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 | (unicode(c) >> 6) AS BIGINT), CAST(128 | (unicode(c) & 63) AS BIGINT)] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc_table
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM coded)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM places a JOIN places b ON left(a.word, a.i - 1) || '*' || substr(a.word, a.i + 1) = left(b.word, b.i - 1) || '*' || substr(b.word, b.i + 1) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM places a JOIN words b ON b.word = left(a.word, a.i - 1) || substr(a.word, a.i + 1)
  UNION SELECT b.word, a.word, a.n FROM places a JOIN words b ON b.word = left(a.word, a.i - 1) || substr(a.word, a.i + 1)
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms last ON last.word = c.root WHERE last.form IS NULL
"""
