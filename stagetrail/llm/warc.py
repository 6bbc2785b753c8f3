"""Pages to WARC archives and back, as a table of chunks.

Oversized payloads never travel whole between Spark and the archives: Spark cuts a payload into rows (record, chunk
number), the writer streams them into one compressed member per record, and the reader gives such rows back with the
digest and the length so far. A record's last chunk has the digest of the whole payload.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response and the others
are revisits without a payload; their HTTP header keeps the full length. Only archives named in the manifest count;
what a lost task wrote is never read.

Edge cases: a null html is an empty payload, a null url gives no target; rows with one page_id and one payload are all
responses; a null page_id is smaller than any other; no pages give no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrail.llm.common import shared_dir, staged

CHUNK = 1 << 18
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_MANIFEST = "path string, records long, bytes long"
_CHUNKS = f"{_RECORD}, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Records in chunks, a record's chunks next to each other and in order. Revisits have one, empty."""
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    records = records.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    first = records.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("response"))
    # The third key keeps the aggregate's partitioning from being reused, so a payload that fills much of the table is split.
    records, first = (x.withColumn("cut", F.substring("digest", 1, 8)) for x in (records, first))
    revisit = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull()
    known = records.join(first, ["digest", "payload_bytes", "cut"]).withColumn("refers_to", F.when(revisit, F.col("response")))
    known = known.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    number = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    return known.select("*", F.explode(F.sequence(F.lit(0), number - 1)).alias("chunk_no")).select(
        "page_id",
        "url",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        "refers_to",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("chunk_no").cast("long").alias("chunk_no"),
        F.col("payload").substr(F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"),
    )


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _heads(row: dict, digest: str) -> bytes:
    """WARC and HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    inside = row["payload_bytes"] if row["record_type"] == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_uri(row['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe=':/?#[]@!$&()*+,;=%~')}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(row['refers_to'])}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + inside}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_archives(pages: DataFrame, folder: str, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Archives in `folder`, one a task; their manifest (path, records, bytes), written beside them."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, records = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(where, recursive=True)
                    out = store.open_output_stream(f"{where}/{name}", compression=None)
                if row["chunk_no"] == 0:
                    full = bytes.fromhex(row["payload_digest"])
                    member, sha, done = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1(), 0
                    out.write(member.compress(_heads(row, b32(full))))
                    records += 1
                sha.update(row["chunk"])
                done += len(row["chunk"])
                out.write(member.compress(row["chunk"]))
                if row["record_type"] == "revisit" or done == row["payload_bytes"]:
                    if row["record_type"] == "response" and sha.digest() != full:
                        raise ValueError(f"payload of page {row['page_id']} is not what its digest says")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.record_batch([[f"{folder}/{name}"], [records], [size]], ["path", "records", "bytes"])

    return staged(chunk_rows(pages, least, chunk).mapInArrow(write, _MANIFEST), "manifest")


class _Members:
    """Bytes of a file of gzip members, read piece by piece."""

    def __init__(self, source, size: int):
        self.source, self.size, self.held, self.member, self.more = source, size, b"", None, b""

    def fill(self) -> bool:
        raw = self.more or self.source.read(self.size)
        if not raw:
            return False
        if self.member is None or self.member.eof:
            self.member = zlib.decompressobj(31)
        self.held += self.member.decompress(raw, self.size)
        self.more = self.member.unconsumed_tail or self.member.unused_data
        return True

    def upto(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.fill():
                if self.held:
                    raise ValueError("an archive ends inside a record")
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self.fill():
                raise ValueError("an archive ends inside a record")
        found, self.held = self.held[:size], self.held[size:]
        return found


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _page(uri: str | None) -> int | None:
    number = (uri or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def read_archives(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the manifest's archives."""

    def records(source) -> Iterator[tuple]:
        stream = _Members(source, chunk)
        while (head := stream.upto(b"\r\n\r\n")) is not None:
            warc = _fields(head)
            http = _fields(first := stream.upto(b"\r\n\r\n"))
            left = int(warc["content-length"]) - len(first) - 4
            told = (
                _page(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], _page(warc.get("warc-refers-to")),
                int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"),
            )
            sha, done, number = hashlib.sha1(), 0, 0
            while True:
                piece = stream.take(min(left, chunk)) if left else b""
                sha.update(piece)
                done, left = done + len(piece), left - len(piece)
                yield *told, number, piece, done, b32(sha.digest()), not left
                number += 1
                if not left:
                    break
            if stream.upto(b"\r\n\r\n") != b"":
                raise ValueError("a record is longer than it says")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        names, types = zip(*[x.split() for x in _CHUNKS.split(", ")], strict=True)

        def batch_of(rows: list[tuple]):
            return pa.record_batch([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(where, compression=None) as source:
                    for row in records(source):
                        rows.append(row)
                        held += len(row[7])
                        if held >= 16 * chunk or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    number = max(1, manifest.count())
    return manifest.select("path").repartition(number, "path").mapInArrow(read, _CHUNKS)


def archived(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Pages written to archives in the shared folder and read back: the chunk table."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder if folder.startswith("file:") else f"file://{folder}"
    return read_archives(spark, write_archives(pages, folder, least, chunk), chunk)


def record_digest(chunks: DataFrame) -> DataFrame:
    """What each record's last chunk says of it; a response's digest is that of the payload as it was read."""
    own = F.col("record_type") == "response"
    return chunks.filter("last").select(
        "page_id",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
