"""Operator 7, WARC: archives as a chunked record table.

A record is written as rows (record, chunk, chunks, data): its WARC header and
the first bytes of its block in chunk 0, the rest in chunks of bounded size. The
rows' data in order are the bytes of a WARC 1.1 file. Digests are carried from
chunk to chunk, in writing and in reading, so that no task ever builds a whole
record beside the payload that it was given. Records of one chunk are read where
they lie; only the rows of larger ones are shuffled, to bring their chunks in order.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with
the largest key is the response and the others revisit it.

Defined results: a null payload is an empty one; an empty payload is a response
of 0 bytes; equal keys with equal payloads are all responses; a null key is
smaller than all others (a response if it has no equal); repeated rows are
written each; an empty table gives an empty archive; the largest key settles
ties; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import join_hot, partitions_for, read, written

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"
#: A chunk table row.
TABLE = "record string, chunk long, chunks long, data binary"


def _page_id(key) -> str:
    return f"urn:page:{'' if key is None else key}"


def headers(key, url: str | None, digest: str, n: int, refers_to) -> bytes:
    """The WARC and HTTP headers of a record; a revisit has no payload, but its HTTP headers still say how long it is."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_page_id(key)}>"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else n))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{_page_id(refers_to)}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + _CRLF + http


def decide(pages: DataFrame, key: str, payload: str, min_revisit: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(key, url, payload, digest, refers_to). Only payloads that occur twice or more are joined on.

    Their table is broadcast if it has at most broadcast_rows rows, otherwise it is joined by a shuffle with hot payloads apart.
    """
    value = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col("url"), value.alias("payload"), F.sha1(value).alias("digest"))
    large = rows.where(F.octet_length("payload") >= min_revisit)
    again = large.groupBy("digest").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again, "warc-again")
    if again.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(again.drop("n")), "digest", "left")
    else:
        joined = join_hot(rows, again, "digest", "n", rows.count(), "left")
    return joined.select("key", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_records(rows: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunk table of (key, url, payload, refers_to)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for key, url, payload, refers_to in zip(*[batch.column(i) for i in range(4)], strict=True):
                view = memoryview(payload.as_buffer())
                sha = hashlib.sha1()
                for i in range(0, len(view), chunk_bytes):
                    sha.update(view[i : i + chunk_bytes])
                first = headers(key.as_py(), url.as_py(), sha.hexdigest(), len(view), refers_to.as_py())
                body = view[:0] if refers_to.is_valid else view
                cuts = [0, *range(max(0, chunk_bytes - len(first)), len(body), chunk_bytes)] if len(first) + len(body) > chunk_bytes else [0]
                for c, i in enumerate(cuts):
                    piece = body[i : cuts[c + 1] if c + 1 < len(cuts) else len(body)]
                    data = b"".join([first if c == 0 else b"", piece, _CRLF + _CRLF if c + 1 == len(cuts) else b""])
                    out.append((f"{part}-{number}", c, len(cuts), data))
                    held += len(data)
                    if held >= 8 * chunk_bytes:
                        yield _rows(out)
                        out, held = [], 0
                number += 1
            if out:
                yield _rows(out)

    return rows.mapInArrow(write, TABLE)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["record", "chunk", "chunks", "data"])


def read_records(table: DataFrame) -> DataFrame:
    """(record_id, url, record_type, payload_bytes, payload_digest, refers_to) of a chunk table, read chunk by chunk.

    The digest of a response is computed from its bytes and must be the one its header states; a revisit's is the header's.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            done: list[tuple] = []
            for chunk, chunks, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                view = memoryview(data.as_buffer())
                if chunk == 0:
                    raw = bytes(view)
                    end = raw.index(b"\r\n\r\n")
                    lines = raw[:end].decode().split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError("a record must begin with its WARC version")
                    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                    http = raw.index(b"\r\n\r\n", end + 4) + 4
                    length = next(int(x.split(b":")[1]) for x in raw[end + 4 : http].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    left = int(fields["content-length"]) - (http - end - 4)
                    state = {"fields": fields, "length": length, "left": left, "sha": hashlib.sha1(), "next": 0}
                    view = view[http:]
                if state["next"] != chunk:
                    raise ValueError("chunks out of order")
                state["next"] += 1
                body = view[: state["left"]]
                state["sha"].update(body)
                state["left"] -= len(body)
                if chunk + 1 == chunks:
                    fields = state["fields"]
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    if state["left"] or fields["warc-type"] == "response" and state["sha"].hexdigest() != stated:
                        raise ValueError(f"record {fields['warc-record-id']} is damaged")
                    refers = fields.get("warc-refers-to")
                    done.append((fields["warc-record-id"][1:-1], fields["warc-target-uri"], fields["warc-type"], state["length"], stated, refers and refers[1:-1]))
            if done:
                columns = list(zip(*done, strict=True))
                names = ["record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if n == "payload_bytes" else pa.string()) for n, x in zip(names, columns, strict=True)], names)

    schema = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    whole = table.where("chunks = 1").mapInArrow(parse, schema)
    many = table.where("chunks > 1").repartition(partitions_for(table.sparkSession), "record").sortWithinPartitions("record", "chunk")
    return whole.unionByName(many.mapInArrow(parse, schema))


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html", min_revisit: int = 1000, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunk table of a record for each page, written in the shared folder."""
    return written(write_records(decide(pages, key, payload, min_revisit), chunk_bytes), "warc")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_records(archive(read(spark, sf_dir, "pages")))
    number = lambda c: F.nullif(F.replace(F.col(c), F.lit("urn:page:"), F.lit("")), F.lit("")).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
