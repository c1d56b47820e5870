"""WARC archives and the chunked record table.

Archives hold one gzip member per record. The reader streams them: a payload of any size becomes
rows of record identifier and chunk number, each with the length and the digest up to that chunk.
The writer passes a payload on in slices of that size too: beyond the row that Spark hands to the
task, neither side holds a whole payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, scratch_path, table

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK = 1 << 16
CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to long, uri string, chunk_no int, "
    "chunk binary, bytes_so_far long, digest_so_far string, is_last boolean"
)


def record_id(page_id: int | None, payload_sha1: str, url: str | None) -> str:
    """Names a record by all of its page's columns: only rows that are equal in all of them share a name."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{payload_sha1}:{zlib.crc32((url or '').encode('utf-8', 'replace')):08x}>"


def page_of(rid: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+):", rid or "")
    return int(found[1]) if found else None


def b32_sha1(raw: bytes | None = None, digest: bytes | None = None) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest() if digest is None else digest).decode()


def payload_slices(payload, size: int = CHUNK):
    """Views of a payload's bytes, slice by slice; the payload isn't copied."""
    view = memoryview(payload)
    return (view[at : at + size] for at in range(0, len(view), size))


def write_record(out, page_id: int | None, url: str | None, payload, payload_sha1: str, response: tuple | None, date: str) -> None:
    """Writes one WARC record to ``out`` as a gzip member, slice by slice.

    ``payload_sha1`` in hexadecimal; ``response`` (page_id, url) names the response that a revisit refers to.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, length = ("response", len(http) + len(payload)) if response is None else ("revisit", len(http))
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, payload_sha1, url)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{b32_sha1(digest=bytes.fromhex(payload_sha1))}")
    if response is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(response[0], payload_sha1, response[1])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    zipper = zlib.compressobj(1, zlib.DEFLATED, 31)
    out.write(zipper.compress("\r\n".join(head).encode("utf-8", "replace") + http))
    if response is None:
        for part in payload_slices(payload):
            out.write(zipper.compress(part))
    out.write(zipper.compress(b"\r\n\r\n") + zipper.flush())


def duplicates(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, digest, response)`` of the pages that revisit another one with an equal payload; response: (page_id, url).

    Narrow rows only; the largest page_id of each digest (and of its rows the largest url) is a
    partially aggregated maximum. Rows without a page_id come last in rank; a digest with no page_id
    at all has no revisits. The join with a very common digest is Spark's to split (skew join): its
    rows are a page_id and a digest.
    """
    narrow = pages.where(F.octet_length("html") >= min_bytes).select("page_id", "digest", "url")
    first = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("response"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and response.page_id is not null").drop("n")
    return narrow.drop("url").join(first, "digest").where("not (page_id <=> response.page_id)").select("page_id", "digest", "response").distinct()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)`` and returns ``(path, n_records)`` per archive.

    A null html is an empty payload. Of the rows whose payloads of at least ``min_bytes`` bytes are
    equal, those with the largest page_id are responses and the others revisit it. Each attempt
    of a task writes its own file, so lost executors leave no broken archive in the result.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    again = duplicates(p, min_bytes).withColumnsRenamed({"page_id": "revisit_id", "digest": "revisit_digest"})
    rows = p.join(again, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest")), "left")

    def run(batches):
        task, out, n = TaskContext.get(), None, 0
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for b in batches:
            for page_id, url, html, digest, response_id, response_url in zip(*(b.column(k) for k in range(6))):
                if out is None:
                    fs, local = pafs.FileSystem.from_uri(path)
                    fs.create_dir(local, recursive=True)
                    out = fs.open_output_stream(f"{local}/{name}", compression=None)  # else the name would have it compressed again
                response = None if response_id.as_py() is None else (response_id.as_py(), response_url.as_py())
                write_record(out, page_id.as_py(), url.as_py(), html.as_buffer(), digest.as_py(), response, date)
                n += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64())], names=["path", "n_records"])

    columns = ("page_id", "url", "html", "digest", F.col("response.page_id").alias("response_id"), F.col("response.url").alias("response_url"))
    return rows.select(*columns).mapInArrow(run, "path string, n_records long")


class _Members:
    """Bytes of a multi-member gzip file, decompressed as they are asked for."""

    def __init__(self, f):
        self.f, self.unzip, self.held, self.raw = f, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        if self.unzip.eof:
            self.raw, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        else:
            self.raw = self.unzip.unconsumed_tail
        if not self.raw:
            self.raw = self.f.read(CHUNK)
        if not self.raw:
            return False
        self.held += self.unzip.decompress(self.raw, CHUNK)
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("archive ends within a line")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes, at least one."""
        while not self.held:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            parts.append(self.take(n))
            n -= len(parts[-1])
        return b"".join(parts)


def headers(lines: _Members) -> dict[str, str]:
    out = {}
    while line := lines.line():
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def chunks(f, size: int = CHUNK):
    """Rows of the chunked record table, from an archive's file object."""
    lines = _Members(f)
    while (version := lines.line()) is not None:
        if version.decode() != VERSION:
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        warc = headers(lines)
        left = int(warc["content-length"])
        start = lines.line()
        left -= len(start) + 2
        http = {}
        while line := lines.line():
            left -= len(line) + 2
            name, _, value = line.decode().partition(":")
            http[name.strip().lower()] = value.strip()
        left -= 2
        said = warc["warc-payload-digest"].removeprefix("sha1:")
        base = (warc["warc-record-id"], page_of(warc["warc-record-id"]), warc["warc-type"], page_of(warc.get("warc-refers-to")), warc.get("warc-target-uri"))
        if warc["warc-type"] == "revisit":
            yield (*base, 0, None, int(http["content-length"]), said, True)
        else:
            digest, done, no = hashlib.sha1(), 0, 0
            while True:
                chunk = lines.exactly(min(size, left))
                left -= len(chunk)
                done += len(chunk)
                digest.update(chunk)
                now = b32_sha1(digest=digest.copy().digest())
                if not left and now != said:
                    raise ValueError(f"payload of {base[0]} fails its digest")
                yield (*base, no, chunk, done, now, not left)
                no += 1
                if not left:
                    break
        if lines.exactly(4) != b"\r\n\r\n":
            raise ValueError("record has no end")


def record_chunks(archives: DataFrame) -> DataFrame:
    """The chunked record table of ``archives(path)``: see CHUNKS. Tasks stream their archives."""
    spark = archives.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(local, compression=None) as f:
                    rows = []
                    for row in chunks(f):
                        rows.append(row)
                        if len(rows) == 64:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    return archives.select("path").repartition(tasks).mapInArrow(run, CHUNKS)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and returns one row per record, read back.

    page_id, payload_bytes, payload_digest (base32 SHA-1 of the full payload), record_type,
    refers_to, n_chunks. A revisit's length and digest are those of the response that it refers to, as
    read back; it fails if there is none with its digest. Repeated rows are records each; rows with
    equal page_id and payload, if it is the largest, are all responses; a null page_id stays null;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    archives, at = table(write_warc(pages, folder, min_bytes), "archives")
    ends = record_chunks(archives).where("is_last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to",
        F.when(F.col("record_type") == "response", F.col("chunk_no") + 1).otherwise(0).alias("n_chunks"),
    )
    found = table(ends, "records")[0]
    delete_path(spark, folder)
    delete_path(spark, at)
    own = found.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("own_bytes"))
    own = own.withColumnsRenamed({"page_id": "own_id", "payload_digest": "own_digest"})
    revisits = found.where("record_type = 'revisit'").join(own, (F.col("refers_to") == F.col("own_id")) & (F.col("payload_digest") == F.col("own_digest")), "left")
    lost = F.raise_error(F.concat(F.lit("a revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(" refers to no response with its payload")))
    checked = revisits.withColumn("payload_bytes", F.coalesce("own_bytes", lost.cast("long"))).select(*found.columns)
    return found.where("record_type <> 'revisit'").unionByName(checked)
