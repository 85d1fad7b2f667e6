"""WARC archives: one gzip member per record, read back sequentially.

Writing: each task makes archives of its rows, as they come, as rows of one table (archive, chunk, data): the chunks of an archive in
order are its bytes, and each holds whole gzip members. An archive that has reached ARCHIVE_BYTES is closed and the next one begins; each begins with a warcinfo record. Spark's
writer puts them on the shared store, so an archive is as safe as any table. Of records with equal payloads the one with the largest page_id is
the response, the others are revisit records that refer to it.

Record ids are of the run, the archive and the record's number in it, so they don't repeat where a page_id does; the page ids stand in fields
of their own. The table has no time of capture: WARC-Date is when the archives were written, in UTC.

Reading: every chunk is read where it lies, without a shuffle; zlib decompresses it bit by bit, one member after the other. A record's header ends at the empty line, Content-Length frames its block, and both digests are computed anew and compared. Records
that hold no page (warcinfo) give no row.

Null html is an empty payload, which is deduplicated like any other. A repeated page_id with equal payload: every row is a record of its
own; those with the largest page_id are responses. Null page_id: written as an empty field and read back as null. Empty table: no archive.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sdkatlas.llm import common

CHUNK = 1 << 20  # compressed; the record that reaches it is the chunk's last
SLICE = 1 << 16  # what a reader decompresses at a time
ARCHIVE_BYTES = 256 << 20  # compressed; the record that reaches it is the archive's last
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
GZIP = 16 + zlib.MAX_WBITS
LEVEL = 3
ARCHIVE = "archive string, chunk int, data binary"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def framed(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record: header, empty line, block, two empty lines."""
    fields = [*fields, ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def archive_head(name: str, identity: uuid.UUID, date: str) -> bytes:
    """The warcinfo record that an archive begins with."""
    block = b"software: sdkatlas\r\nformat: WARC File Format 1.1\r\n"
    return framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{identity.urn}>"), ("WARC-Date", date), ("WARC-Filename", name),
                   ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{digest(block)}")], block)


def one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None,
           identity: uuid.UUID | None = None, date: str | None = None) -> bytes:
    """The record of a page; a new id and the present time where none are given."""
    revisit, date = refers_to is not None, date or now()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{(identity or uuid.uuid4()).urn}>"), ("WARC-Date", date),
              ("WARC-Target-URI", one_line(url)), ("X-Page-ID", "" if page_id is None else str(page_id)),
              ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", one_line(refers_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", str(refers_to))]
    return framed(fields, block)


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


def archive_writer(run: uuid.UUID, date: str, limit: int = ARCHIVE_BYTES):
    """page_id, url, payload, refers_to, refers_url rows of one task to the chunks of its archives."""
    whole = lambda x: None if pd.isna(x) else int(x)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], batch["refers_url"], strict=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, written, chunk, held, name = TaskContext.get().partitionId(), 0, 0, 0, bytearray(), ""
        row = lambda data: pd.DataFrame({"archive": common.texts([name]), "chunk": [chunk], "data": [bytes(data)]})
        records = 0
        for page_id, url, payload, refers_to, refers_url in rows(batches):
            if not records:
                name = f"pages-{part:08d}-{number:06d}.warc.gz"
                held += member(archive_head(name, uuid.uuid5(run, name), date))
            identity = uuid.uuid5(run, f"{name}/{records}")
            held += member(record(whole(page_id), url, payload, whole(refers_to), refers_url, identity, date))
            records += 1
            if len(held) >= min(CHUNK, limit - written):
                yield row(held)
                written, chunk, held = written + len(held), chunk + 1, bytearray()
            if written >= limit:
                number, written, chunk, records = number + 1, 0, 0, 0
        if held:
            yield row(held)

    return write


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream that comes in chunks, each whole; one record is in memory at a time."""
    unpacker, parts, begun = zlib.decompressobj(GZIP), [], False
    for data in chunks:
        while data:
            parts.append(unpacker.decompress(data))
            begun = True
            if not unpacker.eof:
                break
            yield b"".join(parts)
            data, unpacker, parts, begun = unpacker.unused_data, zlib.decompressobj(GZIP), [], False
    if begun:
        raise ValueError("an archive ends inside a gzip member")


def parse(member: bytes) -> tuple | None:
    """A page's fields as RECORD names them; None for a whole record that holds no page."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    length = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a WARC record, or Content-Length does not frame it")
    block = rest[:length]
    if fields["warc-type"] == "warcinfo":
        if fields["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError("an archive's first record is damaged")
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda name: int(v) if (v := fields.get(name)) else None
    response = fields["warc-type"] == "response"
    claimed = fields["warc-payload-digest"].removeprefix("sha1:")
    intact = fields["warc-block-digest"] == f"sha1:{digest(block)}" and (not response or (claimed == digest(payload) and declared == len(payload)))
    return number("x-page-id"), declared, claimed, fields["warc-type"], number("x-refers-to-page"), fields["warc-target-uri"], intact


def read_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks (archive, chunk, data) to records."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_digest": object, "record_type": object, "url": object})

    rows = []
    for batch in batches:
        for data in batch["data"]:
            for record_bytes in members(data[at:at + SLICE] for at in range(0, len(data), SLICE)):
                if (page := parse(record_bytes)) is not None:
                    rows.append(page)
                if len(rows) >= 2000:
                    yield frame(rows)
                    rows = []
    if rows:
        yield frame(rows)


def to_archives(pages: DataFrame, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of page_id, url, html rows, saved. Only payload digests that occur twice are joined; their rows are the hot ones, and
    adaptive execution splits a hot digest, since the other side has one row for it."""
    rows = pages.select("page_id", "url", common.utf8(F.col("html")).alias("payload"))
    keyed = rows.withColumn("_digest", F.sha1("payload"))
    groups = keyed.filter(F.length("payload") >= LEAST_REVISIT).groupBy("_digest").agg(
        F.max("page_id").alias("_largest"), F.max_by("url", F.struct("page_id", "url")).alias("_url"), F.count(F.lit(1)).alias("_n"))
    groups = groups.filter("_n > 1").select(F.col("_digest").alias("_known"), "_largest", F.col("_url").alias("refers_url"))
    joined = keyed.join(groups, F.col("_digest") == F.col("_known"), "left")
    refers = F.when(F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest")), F.col("_largest"))
    parts = joined.select("page_id", "url", "payload", refers.alias("refers_to"), "refers_url")
    return common.saved(parts.mapInPandas(archive_writer(uuid.uuid4(), now(), limit), ARCHIVE), "warc")


def read_records(archives: DataFrame) -> DataFrame:
    """The pages' records of archives as to_archives writes them."""
    return archives.mapInPandas(read_archives, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(to_archives(common.table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The same in SQL; base32 takes the 160 bits of the digest five at a time.
SQL = f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
bits as (select d, list_aggregate(list_transform(range(1, 41), lambda i: right(bin(16 + instr('0123456789abcdef', d[i]) - 1), 4)), 'string_agg', '') as b from (select distinct d from p)),
digests as (select d, list_aggregate(list_transform(range(0, 32), lambda i: substr('{_B32}', cast(list_sum(list_transform(range(0, 5),
  lambda j: cast(substr(b, i * 5 + j + 1, 1) as int) * (1 << (4 - j)))) as int) + 1, 1)), 'string_agg', '') as b32 from bits),
g as (select d, max(page_id) as largest from p group by d)
select page_id, cast(strlen(h) as bigint) as payload_bytes, b32 as payload_digest, case when page_id = largest then 'response' else 'revisit' end as record_type,
  case when page_id <> largest then largest end as refers_to, true as intact
from p join g using (d) join digests using (d)
"""
