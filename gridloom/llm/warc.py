"""WARC archives: a writer that stores repeated payloads once, and a splittable reader.

Writer: one gzip member per record, files rolled at ``roll_bytes``. Of the records with equal payloads
the one with the smallest id is a ``response``; the others are ``revisit`` records that name it.

Reader: a task takes a byte range of a file, scans it for the gzip magic, validates each candidate
by decoding the head of the member as a WARC header, and owns the records that start inside its range, the last of
which it reads past the range's end. Bytes inside a decoded member are never scanned again, so only the
first record of a range relies on validation. Bytes between members are passed over; a record whose head is whole and whose body is cut off, damaged or
of another length than its head says raises, and so does a file that gives another number of records than its manifest.

Defined results: null html is an empty payload; empty payloads equal each other; a null id gets the record id
``null`` and comes back as null, and never is the named response while its group has an id; rows that
repeat the smallest id are all responses; a very long page is one record, held whole by its task; an empty table writes no files and reads back no rows; other columns, whatever
their names, aren't looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.files import limit_batches, make_dir, one_task_each, open_fs, tidied
from gridloom.plans.shared import materialize, workdir

MAGIC = b"\x1f\x8b\x08"
RECORD_URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "file string, offset long, page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``sha1`` and ``first_id`` (null unless the row is to be a revisit). Ids and digests are
    aggregated map-side; the pages are joined only to digests that occur twice, so one exchange moves them."""
    rows = pages.withColumn("sha1", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    big = F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes
    firsts = rows.where(big).groupBy("sha1").agg(F.min("page_id").alias("min_id"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("same"), "min_id")
    later = F.col("min_id").isNotNull() & big & ~F.col("page_id").eqNullSafe(F.col("min_id"))
    return rows.join(firsts, F.col("sha1") == F.col("same"), "left").withColumn("first_id", F.when(later, F.col("min_id"))).drop("same", "min_id")


def _record(page_id, url, html, sha1, first_id) -> bytes:
    payload = (html or "").encode()
    digest = "sha1:" + base32_sha1(sha1)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first_id is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_URN}{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if first_id is not None:
        head += [f"WARC-Refers-To: <{RECORD_URN}{first_id}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = 1 << 30, level: int = 3) -> DataFrame:
    """Write ``pages`` (page_id, url, html). Returns the manifest (file, bytes, records). File names are
    a task attempt's own and only those in the manifest count, so a repeated task does no harm."""
    spark = pages.sparkSession
    limit_batches(spark)
    out = workdir(spark, "warc")
    make_dir(out)

    def write(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa

        sink, name, done, count, size = None, "", [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                if sink is None:
                    name = f"{out}/{uuid.uuid4().hex}.warc.gz"
                    system, path = open_fs(name)
                    sink, count, size = system.open_output_stream(path, compression=None), 0, 0
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = squeeze.compress(_record(*(x.as_py() for x in row))) + squeeze.flush()
                sink.write(data)
                count += 1
                size += len(data)
                if size >= roll_bytes:
                    sink.close()
                    done.append({"file": name, "bytes": size, "records": count})
                    sink = None
        if sink is not None:
            sink.close()
            done.append({"file": name, "bytes": size, "records": count})
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    rows = mark_revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), min_bytes)
    return materialize(rows.select("page_id", "url", "html", "sha1", "first_id").mapInArrow(tidied(write), "file string, bytes long, records long"), "warc-manifest")


def parse_head(data: bytes) -> dict[bytes, bytes] | None:
    """The named fields of a WARC header, names in lower case, or None if ``data`` doesn't begin with a whole one."""
    if not data.startswith(b"WARC/1.") or (end := data.find(b"\r\n\r\n")) < 0:
        return None
    fields = dict(line.split(b":", 1) for line in data[:end].split(b"\r\n")[1:] if b":" in line)
    fields = {name.strip().lower(): value.strip() for name, value in fields.items()}
    return fields | {b"": str(end + 4).encode()} if b"warc-type" in fields and fields.get(b"content-length", b"").isdigit() else None


class RangeScan:
    """The members of a file that start in [start, end)."""

    def __init__(self, source, start: int, end: int, chunk: int = 1 << 20):
        self.source, self.at, self.end, self.chunk = source, start, end, chunk
        self.buffer, self.base = b"", start  # buffer holds the bytes from base on

    def more(self) -> bool:
        data = self.source.read_at(self.chunk, self.base + len(self.buffer))
        self.buffer += data
        return bool(data)

    def members(self) -> Iterator[tuple[int, bytes, dict]]:
        while self.at < self.end:
            self.buffer, self.base = self.buffer[self.at - self.base :], self.at
            while len(self.buffer) < len(MAGIC) and self.more():
                pass
            found = self.buffer.find(MAGIC)
            if found < 0:
                skipped = len(self.buffer) - len(MAGIC) + 1
                self.at += max(1, skipped)
                if skipped < 1:  # the file ends
                    return
                continue
            if self.base + found >= self.end:
                return
            data, used, fields = self.decode(found)
            if fields is None:
                self.at = self.base + found + 1
            else:
                self.at = self.base + found + used
                yield self.base + found, data, fields

    def decode(self, found: int) -> tuple[bytes, int, dict | None]:
        """Decode the member at ``found``: its head first, and the rest only if that is a WARC header. Once it is, the member must be whole."""
        unpack, tail, fed, fields, head, seen = zlib.decompressobj(31), b"", found, None, bytearray(), 0
        while fields is None:  # a little at a time: what fails behind the head is damage, what fails before is no record
            if not tail:
                if unpack.eof or fed >= len(self.buffer) and not self.more():
                    return b"", 0, None
                tail = self.buffer[fed : fed + 4096]
                fed += len(tail)
            try:
                head += unpack.decompress(tail, 512)
            except zlib.error:
                return b"", 0, None
            tail = unpack.unconsumed_tail
            if not b"WARC/1.".startswith(bytes(head[:7])):
                return b"", 0, None
            end, seen = head.find(b"\r\n\r\n", seen), max(0, len(head) - 3)
            if end >= 0 and (fields := parse_head(bytes(head[: end + 4]))) is None:
                return b"", 0, None
        parts = [bytes(head)]
        while not unpack.eof:
            if not tail:
                if fed >= len(self.buffer) and not self.more():
                    raise OSError(f"the record at {self.base + found} is cut off")
                tail = self.buffer[fed : fed + self.chunk]
                fed += len(tail)
            try:
                parts.append(unpack.decompress(tail))
            except zlib.error as error:
                raise OSError(f"the record at {self.base + found} is damaged: {error}") from error
            tail = b""
        data = b"".join(parts)
        if data[int(fields[b""]) + int(fields[b"content-length"]) :] != b"\r\n\r\n":
            raise OSError(f"the record at {self.base + found} isn't as long as its header says")
        return data, fed - len(unpack.unused_data) - found, fields


def _urn(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<" + RECORD_URN.encode() + rb"(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def read_warc(manifest: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of the files in ``manifest`` (file, bytes, records), by splits of ``split_bytes``. Raises if a file gives another number of them."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())])
        for batch in batches:
            for split in batch.to_pylist():
                system, path = open_fs(split["file"])
                rows = []
                with system.open_input_file(path) as source:
                    for offset, data, fields in RangeScan(source, split["lo"], split["hi"]).members():
                        block = data[int(fields[b""]) : int(fields[b""]) + int(fields[b"content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = fields[b"warc-type"].decode()
                        named = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                        if kind == "revisit":
                            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                            own, size, digest = named, int(length[1]) if length else None, named
                        else:
                            digest = own = base32_sha1(hashlib.sha1(payload).hexdigest())
                            size = len(payload)
                        rows.append({"file": split["file"], "offset": offset, "page_id": _urn(fields.get(b"warc-record-id")), "record_type": kind, "target_uri": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "refers_to": _urn(fields.get(b"warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "digest_ok": own == named or not named})
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    splits = manifest.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("lo"), "bytes")
    splits = splits.select("file", "lo", F.least(F.col("lo") + split_bytes, "bytes").alias("hi"))
    total = manifest.where("bytes > 0").agg(F.sum("bytes")).first()[0]
    found = materialize(one_task_each(splits, (total or 0) // split_bytes + 1).mapInArrow(tidied(read), RECORDS), "warc-records")
    counts = found.groupBy("file").agg(F.count("*").alias("found"))
    wrong = manifest.join(counts, "file", "left").where(F.coalesce("found", F.lit(0)) != F.col("records")).first()
    if wrong:
        raise OSError(f"{wrong.file} gives {wrong.found or 0} records, the manifest names {wrong.records}")
    return found


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_warc(write_warc(pages, min_bytes=0))
    wrong = F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("file")))
    checked = records.withColumn("payload_digest", F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(wrong.cast("string")))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of a SHA-1 in SQL: eight groups of five hex digits are four letters each.
OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * i, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT, 1) FOR j IN range(4)], '') FOR i IN range(8)], '') AS payload_digest,
  CASE WHEN page_id = m OR m IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = m OR m IS NULL THEN NULL ELSE m END AS refers_to
FROM g
"""
