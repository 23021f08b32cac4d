"""WARC archives as a chunked record table.

Writing: a payload stays in the Arrow buffer that it came in and becomes rows of (record, chunk number, at most CHUNK
bytes), one at a time, each with the digest of its chunk; a running digest over the chunks must end at the digest that
the JVM found.  A row is written as one WARC record of a text table: record segmentation of the standard (first record,
then ``continuation`` records with segment numbers) carries payloads of several chunks.  So beside the table's own cell a
writer holds a few chunks, however long the payload is.

Reading: an archive is a gzip file and holds one partition of the rows, whose size Spark bounds (its split size, or
AQE's advisory size after a shuffle), so archives are read in parallel though none of them is split.  Records are split
at the separator; no payload holds it, because the writer ends a chunk in the middle of it.  Records of one chunk are checked
where they are read; chunks of segmented ones are sorted by record and number and streamed through one running digest.

Odd rows: null html is an empty payload, a null url an empty one.  A record is known by the partition and row that wrote
it, so repeated ids are records of their own: of equal payloads all with the smallest id are responses.  A row with a
null id is a response and is never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import SLICE_BYTES, map_slices, prepare, raw, shared_dir, texts

#: Bytes of payload in a record at most.
CHUNK = 1 << 20
VERSION = "WARC/1.1\r\n"
#: What stands between the content of a record and the headers of the next.
SEPARATOR = "\r\n\r\n" + VERSION


def base32_sha1(done) -> str:
    return base64.b32encode(done.digest()).decode()


def chunks(payload: bytes | memoryview, size: int = CHUNK) -> Iterator[bytes]:
    """The payload in pieces of at most ``size`` bytes that end between code points; one empty piece for an empty payload.
    No piece holds the separator, nor makes one with the empty lines before and after it."""
    mark, at = SEPARATOR.encode(), 0
    while True:
        end = min(len(payload), at + size)
        while at < end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        if (odd := (b"\r\n\r\n" + payload[at:end] + b"\r\n").find(mark)) >= 0:
            end = at + odd + 4  # after the word WARC, as odd counts from the four bytes put before
        yield bytes(payload[at:end])
        at = end
        if at >= len(payload):
            return


def record_text(record: str, page_id: str | None, url: str, kind: str, number: int, last: bool, total: int, digest: str, refers: str, chunk: bytes, date: str) -> str:
    """A record without the empty lines after it."""
    own = f"<urn:record:{record}>" if number == 1 else f"<urn:record:{record}:{number}>"
    block = base32_sha1(hashlib.sha1(chunk))
    lines = [f"WARC-Type: {kind if number == 1 else 'continuation'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", "Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha1:{block}"]
    if number == 1:
        lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {total}"]
        if page_id is not None:
            lines.append(f"X-Page-ID: {page_id}")
    if not last or number > 1:
        lines += [f"WARC-Segment-Number: {number}", f"WARC-Segment-Origin-ID: <urn:record:{record}>"]
        if last:
            lines.append(f"WARC-Segment-Total-Length: {total}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return VERSION + "\r\n".join([*lines, f"Content-Length: {len(chunk)}", "", ""]) + chunk.decode()


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def payloads(batch: pa.RecordBatch, column: str) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text, where they stand in the batch."""
    at, data = raw(batch.column(column))
    view = memoryview(data)
    return (view[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK) -> None:
    """Write a record per page into archives below ``path``, a folder of any store that Spark can write to."""
    prepare(pages.sparkSession)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")
    rows = texts(pages, id_col, html_col, url).withColumn("sha", F.sha1("text")).withColumn("size", F.octet_length("text"))
    own = rows.filter(F.col("size") >= min_bytes).select("id", "sha", "size")
    first = own.groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = own.join(first, ["sha", "size"]).filter(F.col("id") != F.col("first")).select("id", "sha", "first").distinct()
    rows = rows.join(again, ["id", "sha"], "left").select(F.col("id").cast("string").alias("id"), "url", "text", "sha", F.col("first").cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, out, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i, address, sha, first_id, data in zip(*[batch.column(k).to_pylist() for k in ("id", "url", "sha", "first")], payloads(batch, "text"), strict=True):
                whole = base64.b32encode(bytes.fromhex(sha)).decode()
                kind = "response" if first_id is None else "revisit"
                pieces = chunks(data, chunk) if first_id is None else iter([b""])
                piece, number, running = next(pieces), 1, hashlib.sha1()
                while piece is not None:
                    running.update(piece)
                    following = next(pieces, None)
                    out.append(record_text(f"{part}-{row}", None if i is None else clean(i), clean(address), kind, number, following is None, len(data), whole, first_id, piece, date))
                    held += len(piece)
                    if held >= SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, held = [], 0
                    piece, number = following, number + 1
                if first_id is None and base32_sha1(running) != whole:
                    raise ValueError(f"page {i}: wrong digest")
                row += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parsed(value: str) -> tuple[dict[str, str], bytes] | None:
    """Headers and content of one record as read between separators; None for what is no record."""
    head, _, body = value.removeprefix(VERSION).partition("\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.split("\r\n") if ":" in line)
    if "Content-Length" not in fields:
        return None
    data = body.encode()
    n = int(fields["Content-Length"])
    if data[n:] == b"\r\n\r\n":  # the last record of a file
        data = data[:n]
    if len(data) != n:
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: {len(data)} bytes of {n}")
    return fields, data


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page id, payload_bytes, payload_digest, record_type and refers_to of every record group in archives below path.

    Contents are checked against their digests: a chunk where it is read, a segmented payload by a running digest over
    its chunks in order.  A mismatch or a missing chunk raises.
    """
    prepare(spark)
    lines = spark.read.option("lineSep", SEPARATOR).text(path).select(F.lit(0).alias("id"), F.col("value").alias("text"))

    def work(part):
        out: dict[str, list] = {k: [] for k in ("record", "page", "number", "total", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk")}
        for value in part.column("text").to_pylist():
            if not value.strip() or (got := parsed(value)) is None:
                continue
            fields, data = got
            block = base32_sha1(hashlib.sha1(data))
            kind, number = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1))
            segmented = "WARC-Segment-Number" in fields
            if fields["WARC-Block-Digest"] != f"sha1:{block}" or kind == "response" and not segmented and fields["WARC-Payload-Digest"] != f"sha1:{block}":
                raise ValueError(f"record {fields['WARC-Record-ID']}: wrong digest")
            out["record"].append(fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]))
            out["page"].append(fields.get("X-Page-ID"))
            out["number"].append(number if segmented else 0)
            out["total"].append(int(fields["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in fields else None)
            out["payload_bytes"].append(int(fields["X-Payload-Length"]) if kind == "revisit" else len(data))
            out["payload_digest"].append(fields["WARC-Payload-Digest"].removeprefix("sha1:") if "WARC-Payload-Digest" in fields else None)
            out["record_type"].append(kind)
            out["refers_to"].append(fields["WARC-Refers-To"][len("<urn:page:") : -1] if "WARC-Refers-To" in fields else None)
            out["chunk"].append(data if segmented else None)
        return out

    schema = "record string, page string, number int, total long, payload_bytes long, payload_digest string, record_type string, refers_to string, chunk binary"
    rows = map_slices(lines, work, schema)
    whole = rows.filter("number = 0").select("page", "payload_bytes", "payload_digest", "record_type", "refers_to")
    parts = rows.filter("number > 0").repartition("record").sortWithinPartitions("record", "number")
    joined = parts.select("record", "page", "number", "total", "payload_digest", "record_type", "chunk").mapInArrow(streamed, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return whole.unionByName(joined).select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segmented payload from its chunks in order; holds one running digest."""
    record = page = digest = kind = said = total = None
    size = number = 0

    def close() -> list[dict]:
        if record is None:
            return []
        if total != size or base32_sha1(digest) != said:
            raise ValueError(f"record {record}: {size} of {total} bytes, or a wrong digest")
        return [{"page": page, "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": None}]

    schema = pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in ("record", "page", "number", "total", "payload_digest", "record_type", "chunk")}
            if row["record"] != record:
                out += close()
                record, page, digest, kind, said, size, number = row["record"], row["page"], hashlib.sha1(), row["record_type"], row["payload_digest"], 0, 0
            if row["number"] != number + 1:
                raise ValueError(f"record {record}: chunk {number + 1} is missing")
            number, total = row["number"], row["total"]
            size += len(row["chunk"])
            digest.update(row["chunk"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if last := close():
        yield pa.RecordBatch.from_pylist(last, schema=schema)


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


QUERIES: dict[str, Callable] = {"op8_warc": query}
ORACLE_SQL: dict[str, str] = {
    "op8_warc": """
WITH h AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
v AS (SELECT page_id, t, list_transform(range(8), lambda g: list_reduce(list_transform(range(1, 6), lambda k: instr('0123456789abcdef', substr(x, CAST(5 * g + k AS BIGINT), 1)) - 1), lambda a, b: a * 16 + b)) AS parts FROM h),
b AS (SELECT page_id, t, array_to_string(list_transform(parts, lambda p: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(p // 32768 + 1 AS BIGINT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(p // 1024 % 32 + 1 AS BIGINT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(p // 32 % 32 + 1 AS BIGINT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(p % 32 + 1 AS BIGINT), 1)), '') AS digest FROM v),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, strlen(t)) AS first FROM b)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
