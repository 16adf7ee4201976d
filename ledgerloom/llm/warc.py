"""WARC archives as a chunked record table.

A record's bytes (WARC head, HTTP head, payload, record end) are rows of record
identifier and chunk number; concatenated in that order they are a WARC file. Each row
carries the SHA-256 of the payload so far, so that whoever writes or reads a record holds
one chunk of it and never the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payload bytes in a chunk.
CHUNK = 256 << 10
#: Smaller payloads are always stored, as a revisit record would save nothing.
LEAST_REVISIT = 100

ARCHIVE = "record long, chunk_no int, n_chunks int, data binary, digest string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _head(page_id, url, kind: str, refers_to, digest: str, length: int, date: str) -> bytes:
    """WARC head and HTTP head of a record; the HTTP length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (length if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def record_types(pages: DataFrame, scratch: C.Scratch) -> DataFrame:
    """pages (page_id, url, payload) with digest, payload_bytes, record_type and refers_to.

    Only the digests that occur twice or more are joined; their table is written first, so
    that Spark knows its size, broadcasts it if small, and otherwise splits hot digests.
    """
    rows = pages.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    again = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    again = scratch.save(again.select("digest", "first"), "repeated")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(again, "digest", "left").select(
        "page_id", "url", "payload", "digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archive(records: DataFrame, scratch: C.Scratch, *, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The archive table of records: see record_types for the columns. A row per chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    rows = (
        records.withColumn("record", F.monotonically_increasing_id())
        .withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(stored / chunk)).cast("int"))
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    )
    data = F.when(F.col("record_type") == "response", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    head = [F.when(F.col("chunk_no") == 0, F.col(c)).alias(c) for c in ("page_id", "url", "refers_to")]
    rows = rows.select("record", "chunk_no", "n_chunks", data.alias("data"), "record_type", "payload_bytes", "digest", *head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = hashlib.sha256()  # of the record that the rows now belong to; its chunks come one after another
        for batch in batches:
            blocks, digests = [], []
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                own, no, n = get["data"][i].as_py(), get["chunk_no"][i].as_py(), get["n_chunks"][i].as_py()
                kind, whole = get["record_type"][i].as_py(), get["digest"][i].as_py()
                if no == 0:
                    so_far = hashlib.sha256()
                so_far.update(own)
                digests.append(so_far.hexdigest() if kind == "response" else whole)
                if no == 0:
                    own = _head(get["page_id"][i].as_py(), get["url"][i].as_py(), kind, get["refers_to"][i].as_py(), whole, get["payload_bytes"][i].as_py(), date) + own
                blocks.append(own + b"\r\n\r\n" if no == n - 1 else own)
            yield pa.RecordBatch.from_arrays([get["record"], get["chunk_no"], get["n_chunks"], pa.array(blocks, pa.binary()), pa.array(digests, pa.string())], names=["record", "chunk_no", "n_chunks", "data", "digest"])

    return scratch.save(rows.mapInArrow(run, ARCHIVE), "archive")


class Reader:
    """Reads a record chunk by chunk."""

    def __init__(self) -> None:
        self.fields: dict[str, str] = {}
        self.left, self.sha = 0, hashlib.sha256()

    def feed(self, no: int, data: bytes, last: bool) -> tuple | None:
        if no == 0:
            warc, http, body = data.split(b"\r\n\r\n", 2)
            self.fields = dict(x.split(": ", 1) for x in warc.decode().split("\r\n")[1:])
            self.length = int(re.search(rb"Content-Length: (\d+)", http)[1])
            self.sha = hashlib.sha256()
            self.left = int(self.fields["Content-Length"]) - len(http) - 4
        else:
            body = data
        body = body[: self.left]
        self.left -= len(body)
        self.sha.update(body)
        return self.record() if last else None

    def record(self) -> tuple:
        number = lambda name: (lambda x: int(x) if x else None)(self.fields.get(name, "<urn:page:>")[10:-1])
        kind, told = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha256:")
        digest = self.sha.hexdigest() if kind == "response" else told
        return number("WARC-Record-ID"), self.fields.get("WARC-Target-URI"), self.length, digest, kind, number("WARC-Refers-To"), digest == told and self.left == 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            no = batch.column(0)[i].as_py()
            done = reader.feed(no, batch.column(2)[i].as_py(), no == batch.column(1)[i].as_py() - 1)
            if done:
                rows.append(done)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def read_archive(archive: DataFrame) -> DataFrame:
    """A row per record; `intact` tells whether the payload has its recorded digest and length.

    Records of one chunk are read where they lie. Only those of more are dealt out by
    record and sorted by chunk number; a task then streams them, one chunk in memory.
    """
    cols = ["chunk_no", "n_chunks", "data"]
    one = archive.where("n_chunks = 1").select(*cols).mapInArrow(_read, RECORDS)
    more = archive.where("n_chunks > 1").select("record", *cols).repartition("record").sortWithinPartitions("record", "chunk_no").select(*cols).mapInArrow(_read, RECORDS)
    return one.unionByName(more)


def export_warc(archive: DataFrame, path: str) -> int:
    """Writes the archive as one WARC file, streamed row by row; gives the bytes written."""
    n = 0
    with open(path, "wb") as out:
        for row in archive.select("record", "chunk_no", "data").orderBy("record", "chunk_no").toLocalIterator():
            n += out.write(row.data)
    return n


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Writes a record per page and gives the archive table.

    Null html is an empty payload. Of pages with equal payloads of 100 bytes or more, that
    with the smallest id is the response, also where its row is repeated; the others are
    revisits and store no payload. A null id never is the smallest. A null url gives no
    target field. Extra columns are not read. An empty table gives an empty archive.
    """
    scratch = C.Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    archive = write_archive(record_types(rows, scratch), scratch, chunk=chunk)
    scratch.drop_all_but("archive")
    return archive


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(archive_pages(C.table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
