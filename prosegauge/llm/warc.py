"""WARC archives of pages in which equal payloads are stored once, as revisit records.

``write_archives`` finds equal payloads from headers alone - id, size and digest, shuffled by
digest - and only then shuffles the pages once, into archives of about ``archive_bytes``, each
revisit without its payload. Records are put together as columns; every record is a gzip member of
its own, so that readers can seek to it, and each archive begins with a ``warcinfo`` record. Spark's text
writer writes the members as bytes: it ends each row with a separator, which is the last byte of the
member, the highest one of the record's size (zero below 16 MB; larger records are written for each
such byte). So a lost task leaves no half archive and any file system will do. In the end the driver
renames the archives to ``*.warc.gz``.
``read_archives`` reads the files as bytes, record by record by their lengths, and
``resolve_revisits`` joins revisits to the responses they refer to.

Of the records with equal payloads of at least ``least`` bytes the one with the smallest id is
the response. Defined results: a null payload is empty; a null id is no smaller than any other,
and rows of the same id and payload repeated are all responses or all revisits; a null url has the
record's id as its target, marked as unknown; line ends in a url are percent-encoded. An empty table gives no records. Other
columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.session import removed, renamed, sizes

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, page_id long, url string, record_type string, refers_to_id string, "
    "payload_bytes long, payload_digest string"
)
BATCH = 4096


def headers(pages: DataFrame) -> DataFrame:
    """What is shuffled to find equal payloads: page_id, payload_bytes, payload_digest."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )


def revisits(headers: DataFrame, least: int = 100) -> DataFrame:
    """Rows that repeat the payload of a smaller id: page_id, payload_digest, first_id; distinct."""
    long_enough = headers.where(F.col("payload_bytes") >= least)
    firsts = (
        long_enough.groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    rows = long_enough.groupBy("page_id", "payload_digest").count().drop("count")
    return rows.join(firsts, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))


def record_id(page_id: Column, digest: Column) -> Column:
    """A urn that follows from the id and the payload."""
    hexes = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    parts = [F.substring(hexes, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def records(pages: DataFrame, date: Column) -> DataFrame:
    """The records of annotated pages as text, each without the line end that closes it.

    Needs record_id, page_id, url, payload, payload_bytes, payload_digest and refers_to_id (null: a
    response).
    """
    revisit = F.col("refers_to_id").isNotNull()
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    target = F.replace(F.replace(F.coalesce("url", "record_id"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name: str, value: Column, sign: str = ": ") -> Column:
        return F.coalesce(F.concat(F.lit(name + sign), value, F.lit(CRLF)), F.lit(""))

    def urn(name: str) -> Column:
        return F.concat(F.lit("<"), F.col(name), F.lit(">"))

    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("record_id")),
        line("WARC-Date", date),
        line("WARC-Target-URI", target),
        line("X-Target-Unknown", F.when(F.col("url").isNull(), F.lit("true"))),
        line("WARC-Payload-Digest", digest),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", urn("refers_to_id")),
        line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return pages.select(F.concat(head, block, F.lit(CRLF)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = 64 << 20) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``, as ``*.warc.gz``."""
    heads = headers(pages)
    total, longest = heads.agg(*(F.coalesce(f("payload_bytes"), F.lit(0)) for f in (F.sum, F.max))).first()
    n = max(1, -(-total // archive_bytes))
    payload = F.coalesce("html", F.lit(""))
    digest = F.sha2(payload, 256)
    whole = pages.select(
        record_id(F.col("page_id"), digest).alias("record_id"),
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).alias("payload_bytes"),
        digest.alias("payload_digest"),
    )
    again = revisits(heads, least)
    again = again.select(
        record_id(F.col("page_id"), F.col("payload_digest")).alias("record_id"),
        "first_id",
        record_id(F.col("first_id"), F.col("payload_digest")).alias("refers_to_id"),
    )
    annotated = whole.repartition(n, "record_id").join(again, "record_id", "left")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    made = records(annotated, F.lit(date))
    size = F.octet_length("value") + len(CRLF)
    url_bytes = pages.agg(F.coalesce(F.max(F.octet_length("url")), F.lit(0))).first()[0]
    # a record's fields other than the url, whose line ends become three bytes, take less than 4096 bytes
    for high in range((longest + 3 * url_bytes + 4096 >> 24) + 1):
        rows = made.where(F.shiftright(size, 24) == high).mapInPandas(_members(date, high), "value binary")
        text = rows.select(F.col("value").cast("string"))
        text.write.mode("append").option("lineSep", chr(high)).text(path)
    spark = pages.sparkSession
    for name, written in sizes(spark, path).items():
        if name.startswith("part-") and not written:  # of a task without rows
            removed(spark, f"{path}/{name}")
        elif name.startswith("part-") and name.endswith(".txt"):
            renamed(spark, f"{path}/{name}", f"{path}/{name.removesuffix('.txt')}.warc.gz")


def _info(first: bytes, date: str) -> bytes:
    """The record that describes an archive, named after what comes first in it."""
    fields = f"software: prosegauge{CRLF}format: WARC File Format 1.1{CRLF}"
    name = uuid.UUID(bytes=hashlib.md5(b"info|" + first).digest())
    head = (
        f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{name}>{CRLF}WARC-Date: {date}{CRLF}"
        f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(fields)}{CRLF * 2}"
    )
    return f"{head}{fields}{CRLF * 2}".encode()


def _members(date: str, high: int) -> Callable:
    """Records as gzip members without their last byte, which is ``high``; the archive's own record is before the first."""

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for batch in batches:
            found = []
            for text in batch["value"]:
                record = (text + CRLF).encode()
                member = gzip.compress(record, 6, mtime=0)
                if member[-1] != high:
                    raise ValueError("a record's size is not what its separator says")
                found.append(member[:-1] if begun else gzip.compress(_info(record, date), 6, mtime=0) + member[:-1])
                begun = True
            yield pd.DataFrame({"value": found})

    return compress


def _header(stream) -> dict[str, str] | None:
    """Fields of the header block that begins here; None at the end."""
    first = stream.readline()
    if not first:
        return None
    fields = {"": first.decode().strip()}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        fields[name.lower()] = value.strip()
    return fields


def archive_records(content: bytes) -> Iterator[tuple]:
    """Rows of ``RECORDS`` from the bytes of one archive; a payload's size and digest are its own."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
    while (fields := _header(stream)) is not None:
        if not fields[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {fields['']!r}")
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        if fields["warc-type"] == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        size, digest = int(length.split(b":")[1]), fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-type"] == "response":
            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError("a payload differs from its header")
        page_id = fields.get("x-page-id")
        yield (
            fields["warc-record-id"].strip("<>"),
            None if page_id is None else int(page_id),
            None if "x-target-unknown" in fields else fields.get("warc-target-uri"),
            fields["warc-type"],
            fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            size,
            digest,
        )


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    for batch in batches:
        for content in batch["content"]:
            rows = []
            for row in archive_records(content):
                rows.append(row)
                if len(rows) == BATCH:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records below ``path``: columns of ``RECORDS``. One archive is one task's work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInPandas(_parse, RECORDS)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Records with ``refers_to``: the page of the response that a revisit stands for, else null."""
    plain = found.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    responses = (
        found.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.min("page_id").alias("refers_to"))
    )
    resolved = found.where("record_type = 'revisit'").join(responses, "refers_to_id", "left")
    return plain.unionByName(resolved)
