"""WARC archives: written from pages, read back as a stream of records, and assembled into captures.

An archive is a gzip file, so that one task reads it from its start. Spark's text writer puts the two line ends that close a record; its text reader
splits there again, and the reader below joins what belongs to one block by Content-Length. Memory is bounded by the largest record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_folder, cut
from .common import map_texts

CRLF, CLOSE = "\r\n", "\r\n\r\n"
#: Pages carry no time of their capture; every record bears this one.
DATE = "2000-01-01T00:00:00Z"
MIN_BYTES = 0


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the text's bytes: 5 bytes make 8 digits."""
    h = F.sha1(text)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _id(kind: str, of: Column) -> Column:
    """Record id from a struct of page_id, url and payload digest."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), F.coalesce(of["page_id"].cast("string"), F.lit("-")), F.coalesce(of["url"], F.lit("-")), of["digest"]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str | Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record without the two line ends that close it. Headers of null value are left out."""
    parts = [F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind), F.lit(CRLF))]
    for name, value in [("WARC-Date", F.lit(DATE)), *headers, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]:
        parts.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*parts, F.lit(CRLF), block)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(value): response or revisit, request and metadata record of every row, in this order.

    Of rows whose payloads of at least ``min_bytes`` bytes are equal, the one of least id holds the payload and the others revisit it.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html")})
    me = F.struct("page_id", "url", "digest")
    first = rows.groupBy("digest", "bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), me.alias("page")))["page"].alias("lead"))
    rows = rows.join(first, ["digest", "bytes"])
    is_first = (F.col("bytes") < min_bytes) | F.col("page_id").eqNullSafe(F.col("lead.page_id"))
    own = rows.select("*", is_first.alias("new"), me.alias("me"))
    own = own.withColumns({"id": _id("response", F.col("me")), "refers": F.when(~F.col("new"), _id("response", F.col("lead")))})
    uri = F.col("url")
    for raw, coded in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(raw), F.lit(coded))
    target = ("WARC-Target-URI", uri)
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(CLOSE), F.when(F.col("new"), F.col("html")).otherwise(""))
    profile = F.when(~F.col("new"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    main = _record(F.when(F.col("new"), "response").otherwise("revisit"), [("WARC-Record-ID", F.col("id")), target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", profile), ("WARC-Refers-To", F.col("refers"))], "application/http;msgtype=response", http)
    together = ("WARC-Concurrent-To", F.col("id"))
    request = _record("request", [("WARC-Record-ID", _id("request", F.col("me"))), target, together], "application/http;msgtype=request", F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + CLOSE)))
    about = _record("metadata", [("WARC-Record-ID", _id("metadata", F.col("me"))), target, together], "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    return own.select(F.explode(F.array(main, request, about)).alias("value"))


def write_archives(records: DataFrame, folder: str) -> None:
    """Gzip WARC files in ``folder``, one for each partition."""
    records.write.option("lineSep", CLOSE).option("compression", "gzip").text(folder)


def split_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers, block) of each record; ``chunks`` are an archive's bytes between every two line ends."""
    close, held, head = CLOSE.encode(), bytearray(), None
    for chunk in chunks:
        held += chunk
        held += close
        while True:
            if head is None:
                at = held.find(close)
                if at < 0:
                    break
                head = {}
                for line in held[:at].decode("utf-8", "replace").split(CRLF)[1:]:
                    name, _, value = line.partition(":")
                    head.setdefault(name.strip().lower(), []).append(value.strip())
                del held[: at + len(close)]
                size = int(head.get("content-length", ["0"])[0])
            if len(held) < size + len(close):
                break
            yield head, bytes(held[:size])
            del held[: size + len(close)]
            head = None


READ = "file string, type string, record_id string, concurrent_to array<string>, target_uri string, refers_to string, digest string, payload_bytes long, fields map<string,string>, payload binary"


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the gzip archives in ``folder``.

    ``digest`` is computed from a response's payload and taken from the header of a revisit. ``payloads=False`` leaves the payloads behind.
    """

    def rows(pairs: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
        held: list = [next(pairs, None)]

        def file(name: str) -> Iterator[bytes]:
            while held[0] and held[0][0] == name:
                yield held[0][1]
                held[0] = next(pairs, None)

        while held[0]:
            name = held[0][0]
            for head, block in split_records(file(name)):
                kind, one = head.get("warc-type", [""])[0], lambda k: head.get(k, [None])[0]  # noqa: B023
                payload, digest, fields = None, (one("warc-payload-digest") or "").removeprefix("sha1:") or None, None
                if kind == "response":
                    payload = block.partition(CLOSE.encode())[2]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                elif kind == "metadata":
                    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)]
                yield name, kind, one("warc-record-id"), head.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-refers-to"), digest, None if payload is None else len(payload), fields, payload if payloads else None

    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            held.append(row)
            size += len(row[-1] or b"")
            if len(held) == 500 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    text = spark.read.option("lineSep", CLOSE).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return map_texts(text, each, READ)


def transactions(read: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit record and, nested, the request and metadata records that belong to it.

    Records belong together by WARC-Concurrent-To in either direction, or by way of a request: metadata may name the request of
    the capture instead. Captures without such records have empty lists; requests and metadata that lead to no capture are left out.
    """
    main = read.where(F.col("type").isin("response", "revisit"))
    side = read.where(F.col("type").isin("request", "metadata")).select(F.struct("type", "record_id", "fields").alias("side"), F.col("concurrent_to").alias("to"))
    named = side.select("side", F.explode("to").alias("to"))
    hop = read.where("type = 'request'").select(F.col("record_id").alias("to"), F.explode("concurrent_to").alias("via")).distinct()
    named = named.join(hop, "to", "left").select("side", F.coalesce("via", "to").alias("record_id"))
    back = main.select("record_id", F.explode("concurrent_to").alias("name"))
    back = back.join(side.select("side", F.col("side.record_id").alias("name")), "name").select("side", "record_id")
    lists = named.union(back).groupBy("record_id").agg(F.collect_list("side").alias("sides"))
    none = F.array().cast("array<struct<type:string,record_id:string,fields:map<string,string>>>")
    sides = F.coalesce("sides", none)
    pick = lambda kind: F.filter(sides, lambda x: x["type"] == kind)
    return main.join(lists, "record_id", "left").select("record_id", "type", "target_uri", "refers_to", "digest", "payload_bytes", "payload", pick("request").alias("requests"), pick("metadata").alias("metadata"))


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of ``pages``, from archives that are written and read back.

    Null html is an empty payload. Null ids come last when the least is sought; a payload of null ids only is a response in each. Repeated rows of the least id
    are responses, of other ids revisits; rows equal in id, URL and payload share their record ids. A payload of any length is one record and must fit a
    task. An empty table gives an empty one, and further columns are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(records(pages, **options), folder)
    page = F.try_element_at(F.col("metadata")[0]["fields"], F.lit("page-id"))
    read = cut(read_archives(spark, folder, payloads=False))  # several joins read it
    made = cut(transactions(read).select("record_id", "type", "refers_to", "digest", "payload_bytes", page.try_cast("long").alias("page_id")))
    held = made.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("page_id").alias("from_page"), F.first("payload_bytes").alias("from_bytes"))
    revisits = made.where("type = 'revisit'").join(held, "refers_to", "left")  # responses refer to none, and so stay out of the join
    out = made.where("type = 'response'").withColumns({"from_page": F.lit(None).cast("long"), "from_bytes": F.lit(None).cast("long")}).unionByName(revisits)
    return out.select("page_id", F.coalesce("payload_bytes", "from_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("from_page").alias("refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS UBIGINT) >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & CAST(31 AS UBIGINT) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM p
"""
