"""WARC archives, written and read as streams of chunks.

Writing: one archive per task; every record is a gzip member of its own, its payload passes in
chunks of ``CHUNK`` bytes. Equal payloads are written once, as the response with the largest
id; the others become revisit records that name it. The task returns one row per ``SEGMENT``
of its archive. A task that runs again writes another file, and only the rows of the run that
Spark counts are read on, so archives of lost tasks are ignored.

Reading: one task per segment turns the byte stream into the *chunked record table*: one row
per record and chunk number, each with the SHA-1 of the payload up to and including the chunk.
Neither the archive nor a record is ever held as a whole; the last chunk's digest is the
payload's.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import flag_among, stored
from seqlake.session import scratch_path

CHUNK = 256 << 10       # bytes of payload per chunk row
SEGMENT = 32 << 20      # bytes of archive read by one task
READ_TASKS = 100_000     # tasks that read archives back, at most
BATCH = 4 << 20         # payload bytes per Arrow batch
LEAST = 1000            # payloads from this size on are written once
READ_ROWS = 64          # pages that the Parquet reader holds at a time
ROWS_CONF = "spark.sql.parquet.columnarReaderBatchSize"
ROWS_DEFAULT = "4096"   # Spark's own value of it

CHUNKS = ("record_id string, page_id bigint, record_type string, refers_to bigint, url string, "
          "full_bytes bigint, chunk_no int, chunk binary, digest string, last boolean")


def _header(kind: str, record: str, page: int | None, refers: int | None, url: str | None,
            digest: str, size: int, date: str) -> bytes:
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record}>",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if page is not None:
        lines.append(f"WARC-X-Page-ID: {page}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-X-Refers-To-Page: {refers}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    """``(page_id, url, payload, digest, refers_to)`` -> the segments of one archive."""
    name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
    out, at, begun, segments = None, 0, 0, []
    for batch in batches:
        if out is None:
            fs, path = pafs.FileSystem.from_uri(name)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            out = fs.open_output_stream(path, compression=None)   # members are compressed one by one
        columns = batch.columns
        for i in range(batch.num_rows):
            page, url, digest, refers = (columns[c][i].as_py() for c in (0, 1, 3, 4))
            payload = memoryview(columns[2][i].as_buffer())
            kind = "response" if refers is None else "revisit"
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            data = z.compress(_header(kind, str(uuid.uuid4()), page, refers, url, digest, len(payload), date))
            if kind == "response":
                for p in range(0, len(payload), CHUNK):
                    if data:
                        out.write(data)
                        at += len(data)
                    data = z.compress(payload[p:p + CHUNK])
            data += z.compress(b"\r\n\r\n") + z.flush()
            out.write(data)
            at += len(data)
            if at - begun >= SEGMENT:
                segments.append((begun, at - begun))
                begun = at
    if out is not None:
        out.close()
        if at > begun:
            segments.append((begun, at - begun))
    yield pa.RecordBatch.from_arrays(
        [pa.array([name] * len(segments), pa.string()), pa.array([s[0] for s in segments], pa.int64()),
         pa.array([s[1] for s in segments], pa.int64())], names=["archive", "start", "length"])


class _Stream:
    """Uncompressed bytes of consecutive gzip members, read piece by piece."""

    def __init__(self, source, length: int):
        self.source, self.left = source, length
        self.z = zlib.decompressobj(31)
        self.raw, self.data = b"", b""

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(min(CHUNK, self.left))
            self.left -= len(self.raw)
            if not self.raw:
                return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.data += self.z.decompress(self.raw, CHUNK)
        # at the end of a member that took several calls, unconsumed_tail repeats unused_data
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def upto(self, n: int) -> bytes:
        """The next ``n`` bytes, or fewer at the end."""
        while len(self.data) < n and self._more():
            pass
        out, self.data = self.data[:n], self.data[n:]
        return out

    def head(self) -> bytes | None:
        """Up to and including the next empty line; None at the end."""
        while (i := self.data.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        out, self.data = self.data[:i + 4], self.data[i + 4:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return {k.lower(): v for k, v in pairs}


def _records(stream: _Stream) -> Iterator[tuple]:
    while (head := stream.head()) is not None:
        warc = _fields(head)
        http = stream.head()
        size = int(warc["content-length"]) - len(http)
        full = int(_fields(http)["content-length"])
        page, refers = warc.get("warc-x-page-id"), warc.get("warc-x-refers-to-page")
        common = (warc["warc-record-id"], None if page is None else int(page), warc["warc-type"],
                  None if refers is None else int(refers), warc.get("warc-target-uri"), full)
        if warc["warc-type"] == "revisit":
            yield (*common, 0, b"", warc["warc-payload-digest"].removeprefix("sha1:"), True)
            stream.upto(4)
            continue
        running, number = hashlib.sha1(), 0
        while True:
            chunk = stream.upto(min(CHUNK, size))
            if len(chunk) < min(CHUNK, size):
                raise ValueError(f"record {common[0]} is cut short")
            size -= len(chunk)
            running.update(chunk)
            yield (*common, number, chunk, running.copy().hexdigest(), size == 0)
            number += 1
            if not size:
                break
        stream.upto(4)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(),
             pa.binary(), pa.string(), pa.bool_()]
    for batch in batches:
        for archive, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            fs, path = pafs.FileSystem.from_uri(archive)
            with fs.open_input_file(path) as f:
                f.seek(start)
                rows, size = [], 0
                for r in _records(_Stream(f, length)):
                    rows.append(r)
                    size += len(r[7]) + 200
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Parquet is read ``READ_ROWS`` rows at a time unless the session sets its own number: by
    Spark's number a batch of long pages takes a whole row group, several times over while it grows."""
    if spark.conf.get(ROWS_CONF) != ROWS_DEFAULT:
        yield
        return
    spark.conf.set(ROWS_CONF, str(READ_ROWS))
    try:
        yield
    finally:
        spark.conf.set(ROWS_CONF, ROWS_DEFAULT)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record per row of ``pages``; returns the segments ``archive, start, length``.

    Of rows with equal payloads of at least ``LEAST`` bytes, the one with the largest id is the
    response, the others revisit it. Defined cases: a null text is an empty payload; rows that
    repeat the largest id are all responses; a row without an id revisits the largest id there
    is, and is a response if there is none; white space in a url is folded to one space. Other
    columns are not read. An empty table gives no segments.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                       payload.alias("payload"), F.sha1(payload).alias("digest"))
    src = src.withColumn("_k", F.xxhash64("digest"))
    with _few_rows(pages.sparkSession):
        groups = stored(src.filter(F.octet_length("payload") >= LEAST).groupBy("digest", "_k").agg(
            F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1 AND refers_to IS NOT NULL").drop("n"), "groups")
    # only payloads that may be repeated are shuffled
    flagged = flag_among(src, "_k", groups, "_maybe")
    mark = F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to"))
    alone = flagged.filter("NOT _maybe").withColumn("refers_to", F.lit(None).cast("bigint"))
    maybe = flagged.filter("_maybe").join(groups.drop("_k"), "digest", "left") \
                   .withColumn("refers_to", mark)
    rows = alone.unionByName(maybe, allowMissingColumns=True)
    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")
    folder = scratch_path(pages.sparkSession, "warc")
    with _few_rows(pages.sparkSession):
        return stored(rows.mapInArrow(lambda it: _write(it, folder, date),
                                      "archive string, start bigint, length bigint"), "segments")


def read_archives(segments: DataFrame) -> DataFrame:
    """The chunked record table of the archives: ``CHUNKS``. A record has at least one chunk,
    an empty one if it has no payload; revisit records have no payload. As many tasks as
    segments read them (``READ_TASKS`` at most), dealt by place: the number is given, for the rows
    are so small that adaptive execution would put them all into one task."""
    tasks = max(1, min(segments.count(), READ_TASKS))
    return segments.repartitionByRange(tasks, "archive", "start").mapInArrow(_read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row per record,
    from its chunks; bytes and digest of a revisit are those of the payload it refers to."""
    whole = F.when(F.col("record_type") == "response", F.octet_length("chunk")).otherwise(F.col("full_bytes"))
    return chunks.select("record_id", "page_id", "record_type", "refers_to", whole.alias("n"),
                         F.when(F.col("last"), F.col("digest")).alias("digest")) \
        .groupBy("record_id").agg(
            F.max("page_id").alias("page_id"), F.sum("n").cast("bigint").alias("payload_bytes"),
            F.max("digest").alias("payload_digest"), F.max("record_type").alias("record_type"),
            F.max("refers_to").alias("refers_to")).drop("record_id")
