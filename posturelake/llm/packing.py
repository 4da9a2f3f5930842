"""Best-fit packing of tokenized documents into sequences of fixed capacity.

The packing depends only on how many pieces there are of each length, which are at most ``capacity`` numbers however large the
corpus is. The plan is made from these counts: pieces above a third of the capacity stand at most two to a sequence and are matched
greedily, the longest with the longest that fits; then the shorter ones go, longest first, into the tightest gap. Equal sequences
are handled as one bundle. Pieces find their place by their number within their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.numbering import number_rows
from .common import LOWER, SPACES, UPPER, map_batches

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Parts of words that a worker keeps the ids of; beyond, the half that was met in the most lots stays.
_KEPT = 600_000
_LOT = 4 << 20  # bytes of text encoded at once; a longer text is a lot of its own
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[list(SPACES.encode())] = _SPACE
_KIND[list((UPPER + LOWER).encode())] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(UPPER.encode())] += 32
#: Bytes that make a letter of Latin-1 after 0xC3; those below 0x9F are capitals.
_SECOND = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])
_PLAIN = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x9f-\xb6\xb8-\xbf])+\Z")
#: The characters that a byte-level vocabulary writes for bytes: for those that don't print the characters from 256 on, in the order of the bytes.
_UNSEEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_CHARS = "".join(chr(256 + _UNSEEN.index(b) if b in _UNSEEN else b) for b in range(256))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then the same for the others."""
    end = np.cumsum(size)
    return np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)


class WordEncoder:
    """Ids of texts under a tokenizer that lower-cases, drops white space and ends words with a mark: those of its words, one after another.

    A lot of texts is split by the tokenizer's own rule (contractions, letters, single digits, other signs) as one array of bytes, its distinct parts are
    told apart by a dictionary, and only those not met before are encoded. The rule is applied here to words of printing ASCII and
    Latin-1 letters; a word with anything else goes to the tokenizer as it is written, as does a text that holds a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code: dict[bytes, int] = {}  # part: its row in first, size and met
        self.ids = np.zeros(0, "<u4")
        self.first, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))

    def _whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids

    def _forget(self) -> None:
        stay = np.argsort(-self.met, kind="stable")[: _KEPT // 2]
        names = list(self.code)
        self.code = {names[k]: n for n, k in enumerate(stay.tolist())}
        self.ids = self.ids[_ranges(self.first[stay], self.size[stay])]
        self.size, self.met = self.size[stay], self.met[stay] // 2
        self.first = np.cumsum(self.size) - self.size

    def _codes(self, parts: list[bytes]) -> np.ndarray:
        """The row of each of these distinct parts; new ones are encoded."""
        if len(self.code) > _KEPT:
            self._forget()
        get = self.code.get
        rows = np.array([get(p, -1) for p in parts], np.int64)
        if len(new := np.flatnonzero(rows < 0)):
            rows[new] = np.arange(len(self.code), len(self.code) + len(new))
            ids, size = [], []
            for k, n in zip(new.tolist(), rows[new].tolist()):
                p = parts[k]
                self.code[p] = n
                own = [t.id for t in self.model.tokenize(charmap_decode(p, "strict", _BYTE_CHARS)[0])] if _PLAIN.match(p) else self._whole(p)
                ids += own
                size.append(len(own))
            size = np.array(size, np.int64)
            self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
            self.ids = np.append(self.ids, np.array(ids, "<u4"))
            self.size, self.met = np.append(self.size, size), np.append(self.met, np.zeros(len(size), np.int64))
        self.met[rows] += 1
        return rows

    @staticmethod
    def _split(byte: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Where parts start in texts that each end in white space, the last one in two, and the parts themselves."""
        kind, low = _KIND[byte], _LOWER[byte]
        second = np.flatnonzero(byte == 0xC3) + 1
        second = second[_SECOND[byte[second]]]
        kind[second] = kind[second - 1] = _LETTER
        low[second[byte[second] < 0x9F]] += 32
        if len(odd := np.flatnonzero(kind == _ODD)):  # their words stay whole and as written
            space = np.flatnonzero(kind == _SPACE)
            after = np.unique(np.searchsorted(space, odd))
            first = np.where(after > 0, space[after - 1] + 1, 0)
            whole = _ranges(first, space[after] - first)
            kind[whole], low[whole] = _ODD, byte[whole]
        start = kind != _SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        mark = np.flatnonzero(start & (byte == 0x27) & (kind == _OTHER))
        one, two = low[mark + 1], low[mark + 2]
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | long] + 1] = False
        rest = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[rest[kind[rest] == _LETTER]] = True
        keep = kind != _SPACE
        edge = np.append(np.flatnonzero(start[keep]), np.count_nonzero(keep)).astype(np.int32)
        return np.flatnonzero(start), pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(low[keep])])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        whole = {k: self._whole(t) for k, t in enumerate(texts) if t and any(s in t for s in self.special)}
        split = [b"" if k in whole else t or b"" for k, t in enumerate(texts)]
        start, parts = self._split(np.frombuffer(b" ".join([*split, b" "]), np.uint8))
        known = parts.dictionary_encode()
        _, edge, text = known.dictionary.buffers()
        edge, text = np.frombuffer(edge, np.int32)[: len(known.dictionary) + 1].tolist(), text.to_pybytes() if text else b""
        rows = self._codes([text[a:b] for a, b in zip(edge, edge[1:])])[known.indices.to_numpy()]
        size = self.size[rows]
        raw = self.ids[_ranges(self.first[rows], size)].tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, np.cumsum([len(t) + 1 for t in split]))]
        upto = [0, *(4 * upto).tolist()]
        return [np.array(whole[k], "<u4").tobytes() if k in whole else raw[upto[k] : upto[k + 1]] for k in range(len(texts))]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` in lots of bounded size."""
        lot, held = [], 0
        for t in texts.cast(pa.binary()):
            lot.append(t.as_py())
            held += len(lot[-1] or b"")
            if held > _LOT:
                yield from self.encode(lot)
                lot, held = [], 0
        if lot:
            yield from self.encode(lot)


_encoders: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and its end id, cut after every ``capacity``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder, end, step = _encoders[tokenizer], np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for b in batches:
            who, piece, start, length, crc = [], [], [], [], []
            for k, raw in enumerate(encoder.encode_all(b.column(1))):
                raw += end
                for n, s in enumerate(range(0, len(raw), step)):
                    part = raw[s : s + step]
                    who.append(k), piece.append(n), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the pieces of each length go: rows (length, first, last, sequence, each, at).

    Pieces numbered ``first`` to ``last`` of a length fill sequences from ``sequence`` on, ``each`` to a sequence, the first of
    them at offset ``at``. The size of the plan depends on the capacity alone.
    """
    left, used, rows, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: bundles (first sequence, how many)
    order: list[int] = []

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    def put(length: int, first: int, n: int, each: int, at: int) -> None:
        rows.append((length, used[length], used[length] + n * each - 1, first, each, at))
        used[length] += n * each
        left[length] -= n * each

    third = capacity // 3
    large = [x for x in sorted(left) if x > third]
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:
            b = next((x for x in reversed(large[:at]) if left[x]), None)
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        put(a, sequences, n, 1, 0)
        if b is not None:
            put(b, sequences, n, 1, a)
        open_gap(capacity - a - (b or 0), sequences, n)
        sequences += n

    for length in sorted((x for x in left if x <= third), reverse=True):
        at = bisect_left(order, length)
        while left[length] and at < len(order):
            gap = order[at]
            if not gaps[gap]:
                del gaps[gap], order[at]
                continue
            first, n = gaps[gap].pop()
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, first, full, each, capacity - gap)
                open_gap(gap - each * length, first, full)
            if full < n:
                if rest := left[length]:
                    put(length, first + full, 1, rest, capacity - gap)
                    open_gap(gap - rest * length, first + full, 1)
                    full += 1
                open_gap(gap, first + full, n - full)
            at = bisect_left(order, length)
        if n := left[length]:
            each = capacity // length
            if full := n // each:
                put(length, sequences, full, each, 0)
                open_gap(capacity - each * length, sequences, full)
                sequences += full
            if rest := left[length]:
                put(length, sequences, 1, rest, 0)
                open_gap(capacity - rest * length, sequences, 1)
                sequences += 1
    return pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "each", "at"]).astype("int64")


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) and their ``sequence_id`` and ``offset``; numbered within a length by ``order``."""
    numbered = number_rows(items, [F.col(c) for c in order], within=["length"], out="__nth")
    counts = dict(numbered.groupBy("length").count().collect())  # at most ``capacity`` rows
    spark = items.sparkSession
    steps = spark.createDataFrame(plan(counts, capacity), "length long, first long, last long, sequence long, each long, at long")
    steps = steps.withColumnRenamed("length", "__length")
    here = F.col("__nth") - F.col("first")
    placed = numbered.join(F.broadcast(steps), (F.col("length") == F.col("__length")) & F.col("__nth").between(F.col("first"), F.col("last")))  # bounded by the capacity
    placed = placed.withColumns({"sequence_id": F.col("sequence") + F.floor(here / F.col("each")), "offset": F.col("at") + F.pmod(here, F.col("each")) * F.col("length")})
    return placed.drop("__nth", "__length", "first", "last", "sequence", "each", "at")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document is its ids and the end id; a null or empty text is the end id alone. Only documents longer than ``capacity`` are cut.
    Rows that repeat an id are documents of their own. Pieces that tie in all but their place may swap places.
    """
    parts = cut(pieces(docs, tokenizer or tokenizer_path(), capacity, id_col, text_col))
    return pack(parts, ["doc_id", "piece", "ids_crc32"], capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
