"""WARC archives through a chunked record table.

A payload travels as rows (record, chunk number, bytes, bytes so far, SHA-1 so far of the last chunk), so neither the writer nor
the reader ever holds more than one chunk of a record.  Records are gzip members, one per
record; files are written under a name of their own per task attempt and only those that the successful
attempts report are read, so a lost executor costs a rewrite and no duplicate.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zealmark.llm.common import opened, partitions, prepare
from zealmark.session import scratch_path, stage

CHUNK_BYTES = 1 << 16
READ_BYTES = 1 << 18
# Fixed values of the format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, n_records bigint"
CHUNKS = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, chunk_no bigint, data binary, bytes_so_far bigint, digest_so_far string"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_table(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per page: page_id, url, payload (binary), payload_bytes, sha1 (hex), record_type, refers_to.

    Records of equal payloads of at least ``min_bytes`` share one response, that
    of the largest page_id (null is below every number); the others are
    revisits of it.  Rows that repeat page_id and payload of the response are
    responses too.  Null html is an empty payload.  Only digests and ids are
    grouped; payloads meet their decision by (page_id, digest), so a payload
    that very many pages share is no hot key.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"payload_bytes": F.length("payload").cast("bigint"), "sha1": F.sha1("payload")})
    narrow = stage(rows.select("page_id", "sha1", "payload_bytes"), "warc-digests")
    first = narrow.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("copies"))
    # decisions only for the copies: the rest are responses
    copies = narrow.distinct().join(first.where("copies > 1").drop("copies"), "sha1").where("not (page_id <=> kept_id)")
    decided = copies.select(F.col("page_id").alias("copy_id"), F.col("sha1").alias("copy_sha1"), "kept_id", F.lit(True).alias("is_copy"))
    out = rows.join(decided, F.expr("page_id <=> copy_id and sha1 = copy_sha1"), "left")
    return out.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "sha1",
        F.when(F.col("is_copy"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("is_copy"), F.col("kept_id")).alias("refers_to"),
    )


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Payloads of the responses as rows (record, chunk_no, data); a revisit or an empty payload is one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.floor((stored - 1) / chunk_bytes)).cast("bigint")
    return records.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no")).select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        "payload_bytes",
        "sha1",
        "chunk_no",
        (F.col("chunk_no") == last).alias("is_last"),
        F.when(
            F.col("record_type") == "response",
            F.expr(f"substring(payload, cast(chunk_no * {chunk_bytes} + 1 as int), {chunk_bytes})"),
        )
        .otherwise(F.lit(b""))
        .alias("data"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _clean(value: str | None) -> str:
    """Header values end at the line; line ends inside are percent-encoded."""
    return "" if value is None else value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _header(row: dict, written: str) -> bytes:
    lines = [
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_urn(row['page_id'])}",
        f"WARC-Date: {written}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(row['sha1']))}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['url'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {row['payload_bytes'] if row['record_type'] == 'response' else 0}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"


def _writer(folder: str, written: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        path, out, member, records = "", None, None, 0
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in columns.items()}
                if out is None:
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                if row["chunk_no"] == 0:
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(_header(row, written)))
                    records += 1
                out.write(member.compress(row["data"]))
                if row["is_last"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [records]})

    return write


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str | None = None) -> list[str]:
    """Write one record per page and return the paths of the files that belong to the archive.

    ``date`` is the time that every record carries, by default that of the call (UTC).

    A path per file comes back to the driver, so their number is the number of partitions.
    """
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    records = record_table(pages, min_bytes)
    # a task reads its rows in order and explode keeps a record's chunks together and in order
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    written = chunk_table(records, chunk_bytes).mapInArrow(_writer(folder, date), FILES)
    return sorted(row.path for row in written.collect())


class _Members:
    """Bytes of a run of gzip members, a bounded piece at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.plain, self.member = stream, b"", b"", zlib.decompressobj(31)

    def more(self) -> bool:
        if self.member.eof:
            self.raw, self.member = self.member.unused_data or self.raw, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.stream.read(READ_BYTES)
            if not self.raw:
                return False
        got = self.member.decompress(self.raw, READ_BYTES)
        self.raw = b"" if self.member.eof else self.member.unconsumed_tail
        self.plain += got
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = -1
        while (at := self.plain.find(mark)) < 0:
            if not self.more():
                return None
        got, self.plain = self.plain[:at], self.plain[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        while len(self.plain) < n and self.more():
            pass
        got, self.plain = self.plain[:n], self.plain[n:]
        return got


def _page(urn: str) -> int | None:
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "none" else int(inner)


def _rows(path: str, chunk_bytes: int, with_data: bool) -> Iterator[dict]:
    """A row per chunk of the archive at ``path``, with the digest of what was read so far on a record's last chunk."""
    fs, name = opened(path)
    with fs.open_input_stream(name, compression=None) as stream:
        members = _Members(stream)
        while (head := members.until(b"\r\n\r\n")) is not None:
            lines = head.decode().split("\r\n")
            if lines[0].encode() != VERSION:
                raise ValueError(f"no WARC record at its place in {path}: {lines[0]!r}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            left, chunk_no, so_far, digest = int(fields["Content-Length"]), 0, 0, hashlib.sha1()
            url = fields.get("WARC-Target-URI")
            base = {
                "record_id": fields["WARC-Record-ID"],
                "page_id": _page(fields["WARC-Record-ID"]),
                "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
                "record_type": fields["WARC-Type"],
                "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
                "payload_bytes": int(fields["X-Payload-Length"]),
                "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            }
            while True:
                data = members.take(min(left, chunk_bytes))
                digest.update(data)
                so_far, left = so_far + len(data), left - len(data)
                last = left == 0 or not data
                yield base | {
                    "chunk_no": chunk_no,
                    "data": data if with_data else b"",
                    "bytes_so_far": so_far,
                    "digest_so_far": base32_sha1(digest.digest()) if last else None,
                }
                chunk_no += 1
                if last:
                    break
            if left or members.take(4) != b"\r\n\r\n":
                raise ValueError(f"record {base['record_id']} in {path} is cut short")


def read_warc(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk rows of the archives at ``paths``; ``with_data=False`` reads and digests payloads but returns no bytes of them."""
    kinds = pa.schema(
        [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary())]
        + [("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held: list[dict] = []
                size = 0
                for row in _rows(path, chunk_bytes, with_data):
                    held.append(row)
                    size += len(row["data"])
                    if len(held) >= 1000 or size >= 16 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    files = spark.createDataFrame([(path,) for path in paths], "path string")
    return files.repartition(max(1, min(len(paths), 4 * partitions(spark))), "path").mapInArrow(read, CHUNKS)


def records_of(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: a response's size and digest are those of the bytes read, a revisit's are declared."""
    read = F.col("record_type") == "response"
    whole = chunks.where("digest_so_far is not null").select(
        "page_id",
        F.when(read, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    return whole


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages' archive into the shared folder and read its records back."""
    prepare(spark)
    return records_of(read_warc(spark, write_warc(pages, scratch_path(spark, "warc")), with_data=False))
