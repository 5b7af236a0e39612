"""WARC archives as a table of chunk rows.

An archive is rows of (record, chunk number, last, bytes, running digest). A
record whose payload fits in one chunk is one row; an oversized one continues in
rows of bounded size. The bytes of all rows in order are a WARC 1.1 stream.
Neither writer nor reader ever joins the pieces of a record; the SHA-1 is carried
from piece to piece and checked at each one when read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import map_batches
from matchweave.sources.scratch import scratch_table

ARCHIVE = "record long, chunk int, last boolean, bytes binary, sha1 binary"
_GAP = b"\r\n\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
_REVISIT = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(_id, _digest, response) of the pages whose payload another page, ``response``, has as well and stands for.

    One row per distinct page_id and payload; ``pages`` has page_id and payload.
    Payloads below ``least`` bytes have no response to refer to. Only digests are
    shuffled, and added up before that.
    """
    own = pages.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least).distinct()
    own = scratch_table(own, "digests")
    best = own.groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    return own.join(best, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("response"))).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "response")


def record_id(page: int | None, digest: str) -> str:
    """A record's name: the same for equal page and payload, so a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page} {digest}')}>"


def header(page: int | None, url: str | None, digest: str, size: int, response: int | None) -> bytes:
    """The WARC header of a record and, for a response, the HTTP header."""
    revisit = response is not None
    http = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}", f"Content-Length: {len(http) + (0 if revisit else size)}", "Content-Type: application/http; msgtype=response",
    ]
    if page is not None:
        lines.append(f"X-Page: {page}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(response, digest)}", f"X-Refers-To-Page: {response}", _REVISIT]
    return "\r\n".join(lines).encode() + _GAP + http


def write_archive(pages: DataFrame, chunk_bytes: int = 1 << 18, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", batch_bytes: int = 1 << 22) -> DataFrame:
    """Write one record per page and return the archive's chunk table.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    largest id is a response and the others are revisits without a payload.
    Null payloads are empty; a null id is never referred to; rows that repeat an
    id with the same payload are written alike, under the same record name.

    The list of revisits is joined to the pages; Spark broadcasts it if its bytes
    are few and shuffles both sides by page and digest otherwise. Each chunk goes
    to the worker as a row of its own. The worker holds one batch of rows and at
    most about ``batch_bytes`` of chunks to write.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    known = scratch_table(revisits(pages, least), "revisits")
    own = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    typed = own.join(known, own["page_id"].eqNullSafe(known["_id"]) & (own["digest"] == known["_digest"]), "left")
    size = F.octet_length("payload")
    pieces = F.when(F.col("response").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(size / chunk_bytes).cast("int")))
    rows = typed.select("page_id", "url", "digest", size.cast("long").alias("size"), "response", "payload", pieces.alias("pieces"))
    # A row for each chunk; the rows of a record follow one another.
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    piece = F.when(F.col("response").isNull(), F.substring(F.col("payload"), F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = rows.select("page_id", "url", "digest", "size", "response", "k", (F.col("k") == F.col("pieces") - 1).alias("last"), piece.alias("piece"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, running = TaskContext.get().partitionId() << 40, hashlib.sha1()
        names, kinds = ["record", "chunk", "last", "bytes", "sha1"], [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        out: list[tuple] = []
        held = 0

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for page, url, digest, size, response, k, last, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece, head = piece or b"", b""
                if k == 0:
                    running, record = hashlib.sha1(), record + 1
                    head = header(page, url, base64.b32encode(digest).decode(), size, response)
                running.update(piece)
                out.append((record, k, last, head + piece + (_GAP if last else b""), running.digest()))
                held += len(head) + len(piece) + 100
                if held >= batch_bytes:
                    yield written()
                    out, held = [], 0
        if out:
            yield written()

    return scratch_table(map_batches(rows, write, ARCHIVE), "archive")


def read_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record from chunk rows in order of record and chunk; see ``read_archive``."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    head: dict[str, str] = {}
    running, size, expected, current = hashlib.sha1(), 0, -1, None
    number = lambda name: int(head[name]) if name in head else None
    for batch in batches:
        done = []
        for record, chunk, last, data, digest in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if chunk == 0:
                if current is not None:
                    raise ValueError(f"record {current} has no end")
                top, data = data.split(_GAP, 1)
                head = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
                if head["WARC-Type"] == "response":
                    data = data.split(_GAP, 1)[1]
                running, size, expected, current = hashlib.sha1(), 0, 0, record
            if record != current or chunk != expected:
                raise ValueError(f"record {record} lacks a chunk before {chunk}")
            expected += 1
            if last and data[-4:] != _GAP:
                raise ValueError(f"record {record}: chunk {chunk} is damaged")
            data = data[:-4] if last else data
            running.update(data)
            size += len(data)
            if digest != running.digest():
                raise ValueError(f"record {record}: chunk {chunk} is damaged")
            if not last:
                continue
            stated, found = number("X-Payload-Length"), base64.b32encode(running.digest()).decode()
            if head["WARC-Type"] == "response" and (size, f"sha1:{found}") != (stated, head["WARC-Payload-Digest"]):
                raise ValueError(f"record {record}: the payload differs from its header")
            done.append((number("X-Page"), stated, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number("X-Refers-To-Page")))
            current = None
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if current is not None:
        raise ValueError(f"record {current} has no end")


def read_archive(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    Records of one row are read where they lie; only the rows of oversized ones are
    brought together, sorted by record and chunk and streamed. Every running digest
    and length is checked; a mismatch or a missing chunk raises ValueError. A
    revisit's length and digest are those of the full payload, as its header says.
    """
    whole = (F.col("chunk") == 0) & F.col("last")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    oversized = archive.where(~whole).repartition("record").sortWithinPartitions("record", "chunk")
    return map_batches(archive.where(whole), read_chunks, schema).unionByName(map_batches(oversized, read_chunks, schema))
