"""Corpus-wide line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import SPACES, lower_ascii, nested, sized

_NO_ID = -(2**63)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column, min_chars: int) -> Column:
    """MD5 of the line's key (the line without ASCII white space at its ends, A-Z in lower case) as 16 bytes; null for a line whose key is too short to count."""
    key = lower_ascii(F.btrim(line, F.lit(SPACES)))
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without those at the places ``gone``, which are sorted and from 1: the runs between them, one after another."""
    edges = F.concat(F.array(F.lit(0)), gone, F.array(F.size(lines) + 1))
    runs = F.transform(F.sequence(F.lit(1), F.size(gone) + 1), lambda k: F.slice(lines, edges[k - 1] + 1, edges[k] - edges[k - 1] - 1))
    return F.flatten(runs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, kept, n_lines, n_dropped) of every row: the row as a struct, its text after the drop, its lines before and how many went.

    A line whose key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents goes from every
    document but the one of largest id. Lines are exploded once, as hash and position; the hashes that many documents hold are joined to
    them, and a text is put together again from the runs between the positions that it loses, in time linear in its lines.

    Null or empty text is one empty line. Rows that share an id are one document in the counts, and each loses or keeps
    lines as that document does; so do rows of null id, which count as one document, below every other. Repeated rows each get their row. Texts of
    any length are split whole, a line within one row of the shuffle. An empty table gives an empty one. Since the row is a struct, columns of any name do no harm.
    """
    rows = nested(docs, text=F.coalesce(F.col(text_col).cast("string"), F.lit("")), id=F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)))
    rows = rows.withColumn("digest", F.xxhash64("text"))  # rows of one id need not have one text
    places = rows.select("id", "digest", F.posexplode(F.transform(_lines(F.col("text")), lambda x: _digest(x, min_chars))).alias("pos", "h"))
    found = cut(places.where("h IS NOT NULL").withColumn("pos", F.col("pos") + 1))
    common = cut(found.groupBy("h").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("h", "keeper"))  # a table of its own, so that Spark can split a hot hash in the join
    lost = found.join(sized(common), "h").where("id <> keeper").groupBy("id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    joined = rows.join(lost, ["id", "digest"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(_lines(F.col("text")), F.col("gone")), "\n"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select("doc", kept.alias("kept"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""
    out = dedup_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line, key FROM (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.keeper AS lost FROM lines l LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
