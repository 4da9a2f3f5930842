"""Token counts of fields and sections by offset-mapped attribution.

A row's fields are joined to one document that is encoded once. A token's character span is mapped to the sections that it touches by an
interval join of two ordered lists, and a token that crosses a boundary is allocated to one section by a rule, so that a document's counts add
up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Between two fields; it counts to the field before it.
JOINT = "\n"
#: Who gets a token that crosses: the section of its first character, of its last, or of most of its characters (the earlier one of equal shares).
RULES = ("first", "last", "most")

_encoders: dict[str, tuple] = {}


def encoder(path: str):
    """A tiktoken encoding, and the byte length of each of its tokens."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), length
    return _encoders[path]


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token; a token that holds part of a character's bytes touches the character."""
    encoding, length = encoder(path)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    end = np.cumsum(length[ids])
    starts = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    character = np.cumsum(starts) - 1  # of each byte
    return character[end - length[ids]], character[end - 1] + 1


def attribute(first: np.ndarray, past: np.ndarray, edge: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each section its tokens, and those of them that cross one of its edges.

    Sections tile the text: section i holds the characters from ``edge[i]`` up to ``edge[i + 1]``; empty ones hold no token.
    """
    low, high = (np.searchsorted(edge, x, side="right") - 1 for x in (first, past - 1))
    own = high if rule == "last" else low.copy()
    if rule == "most":
        for i in np.flatnonzero(high > low):
            parts = np.arange(low[i], high[i] + 1)
            share = np.minimum(edge[parts + 1], past[i]) - np.maximum(edge[parts], first[i])
            own[i] = parts[np.argmax(share)]
    sections = len(edge) - 1
    return np.bincount(own, minlength=sections), np.bincount(own[high > low], minlength=sections)


def count_tokens(docs: DataFrame, fields: Sequence[str] = ("text",), id_col: str = "doc_id", rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, field, section, start, n_chars, n_tokens, n_crossing): a row for each line of each field of every row.

    ``section`` numbers a field's lines from 0, ``start`` and ``n_chars`` are in code points of the joined document, a line's end belongs to the line.
    ``n_crossing`` counts those of its tokens that also touch another section. A null or empty field is one empty line without tokens; repeated rows each
    get their rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    fields = list(fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, out = [], [[] for _ in range(6)]
            for k, values in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                name, number, size, parts = [], [], [], []
                for f, value in enumerate(values):
                    lines = (value or "").split("\n")
                    parts.append(value or "")
                    size += [len(x) + 1 for x in lines[:-1]] + [len(lines[-1]) + (f < len(values) - 1)]
                    name += [fields[f]] * len(lines)
                    number += range(len(lines))
                edge = np.concatenate([[0], np.cumsum(size)])
                text = JOINT.join(parts)
                tokens = attribute(*token_spans(text, vocabulary), edge, rule) if text else (np.zeros(len(size), np.int64),) * 2
                who += [k] * len(size)
                for column, more in zip(out, (name, number, edge[:-1], size, *tokens)):
                    column += list(more)
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *map(pa.array, out, kinds)], ["doc_id", "field", "section", "start", "n_chars", "n_tokens", "n_crossing"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return map_texts(texts, each, "doc_id long, field string, section int, start long, n_chars long, n_tokens long, n_crossing long")
