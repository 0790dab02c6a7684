"""WARC archives as a chunked record table.

Neither side holds a whole payload in Python. Spark cuts payloads into rows (record, chunk number) of
at most ``CHUNK`` bytes before the writer, which feeds them to a gzip member for each record and
carries the SHA-256 from chunk to chunk; the reader yields such rows again and carries digest and length
forward, so that a record's last row holds the digest of the whole payload.

What is a revisit is decided on rows (page_id, digest). Only payloads whose digest may occur twice are
shuffled, to meet the decision; all others are written where they were read.

Defined results: a null payload is empty; a null url writes no target; a null id is written as
``urn:page:null`` and read back as null; rows that repeat the smallest id of a group of equal
payloads are all responses; an empty table writes no archive and reads back no row; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_rows, filesystem, marked, new_folder, written

#: Bytes of a payload handled at once; chunks in an Arrow batch.
CHUNK, BATCH = 1 << 18, 128
#: Payloads shorter than this are always written out.
LEAST_REVISIT = 100
#: Groups of equal payloads that are sent to every task, some 100 bytes each.
MOST_SENT = 1 << 18
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "path string, n_records long"
CHUNKS = "page_id long, chunk_no int, data binary, n_bytes long, is_last boolean, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


class _Member:
    """One gzip member of an output file, fed in pieces."""

    def __init__(self, out):
        self.out, self.z = out, zlib.compressobj(1, zlib.DEFLATED, 31)

    def put(self, piece) -> None:
        if packed := self.z.compress(piece):
            self.out.write(packed)

    def close(self) -> None:
        self.out.write(self.z.flush())


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _header(record_type: str, page_id, url, size: int, digest: str, refers_to, block: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {block}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def decided(records: DataFrame, least: int = LEAST_REVISIT, most: int = MOST_SENT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of (page_id, url, payload).

    Payloads are read once for a narrow table of their digests, in which groups of equal ones are counted with
    map-side combining, and once more to be written. Up to ``most`` groups (counted first) go to every task;
    with more, payloads that a bitmap of the groups lets through are shuffled to them, a hot digest's rows
    split by the skew join, and the others are read beside them without being shuffled or hashed twice.
    """
    digest, size, short_hash = F.sha2("payload", 256).alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"), F.xxhash64("payload").alias("hash")
    narrow = written(records.select("page_id", size, digest, short_hash), "warc-digests")
    copied = narrow.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"), F.first("hash").alias("hash"))
    groups = written(copied.where("copies > 1 and first_id is not null").select(F.col("payload_digest").alias("group_digest"), "first_id", "hash"), "warc-groups")
    known = groups.select("group_digest", "first_id")
    rows = records.select("page_id", "url", "payload", size, digest)
    refers_to = F.when(F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True)) & (F.col("payload_bytes") >= least), F.col("first_id")).alias("refers_to")
    if groups.count() <= most:
        return rows.join(F.broadcast(known), F.col("payload_digest") == F.col("group_digest"), "left").select(*rows.columns, refers_to)
    # The short hash tells which rows to leave out before the long one is made.
    some = marked(records.select("page_id", "url", "payload", short_hash), groups.select("hash"), "copied")
    plain = ["page_id", "url", "payload", size, digest]
    there = (F.length("payload") >= least) & F.col("copied")
    alone = some.where(~there).select(*plain, F.lit(None).cast("long").alias("refers_to"))
    joined = some.where(there).select(*plain).join(known.hint("merge"), F.col("payload_digest") == F.col("group_digest"), "left")
    return alone.unionByName(joined.select(*rows.columns, refers_to))


def chunked(records: DataFrame) -> DataFrame:
    """A row for each chunk of a record's payload, in order and next to each other; a revisit has one, without data."""
    n = F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / CHUNK).cast("int")))
    rows = records.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)))
    return rows.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no", (F.col("chunk_no") == n - 1).alias("is_last"), data.alias("data"))


def _writer(folder: str):
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = filesystem(folder)
        path, out, member, digest, n = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None, None, None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path, compression=None)
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                at = {k: v[i].as_py() for k, v in columns.items() if k != "data"}
                revisit = at["refers_to"] is not None
                data = memoryview(columns["data"][i].as_buffer() or b"")
                if at["chunk_no"] == 0:
                    member, digest = _Member(out), hashlib.sha256()
                    block = len(HTTP_HEAD) + (0 if revisit else at["payload_bytes"])
                    member.put(_header("revisit" if revisit else "response", at["page_id"], at["url"], at["payload_bytes"], at["payload_digest"], at["refers_to"], block))
                    member.put(HTTP_HEAD)
                member.put(data)
                digest.update(data)
                if at["is_last"]:
                    if not revisit and digest.hexdigest() != at["payload_digest"]:
                        raise ValueError("a record's chunks are not those of its payload")
                    member.put(b"\r\n\r\n")
                    member.close()
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, schema=schema)

    return run


def write_archives(records: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write (page_id, url, payload binary) as .warc.gz files; returns the manifest (path, n_records).

    A file's name holds the attempt that wrote it and only files in the manifest are read, so a
    retried or speculative task leaves no half record in the result.
    """
    spark = records.sparkSession
    with batch_rows(spark, BATCH):
        return written(chunked(decided(records, least)).mapInArrow(_writer(folder or new_folder(spark, "warc")), MANIFEST), "warc-manifest")


class _Inflated:
    """Bytes of a multi-member gzip stream, read in pieces."""

    def __init__(self, stream):
        self.stream, self.z, self.held, self.raw = stream, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            piece = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def until(self, end: bytes) -> bytes | None:
        """Bytes up to and including end; None at the end of the stream."""
        start = 0
        while (k := self.held.find(end, start)) < 0:
            start = max(0, len(self.held) - len(end))
            if not self._more():
                return None
        found = bytes(self.held[: k + len(end)])
        del self.held[: k + len(end)]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of at most CHUNK."""
        while n:
            if not self.held and not self._more():
                raise EOFError("archive ends inside a record")
            piece = bytes(self.held[: min(n, CHUNK)])
            del self.held[: len(piece)]
            n -= len(piece)
            yield piece


def chunk_rows(stream, with_data: bool = True) -> Iterator[tuple]:
    """(page_id, chunk_no, data, n_bytes, is_last, payload_bytes, payload_digest, record_type, refers_to, digest_ok) of an archive."""
    source = _Inflated(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        ids = [None if (urn := fields.get(name)) in (None, "<urn:page:null>") else int(urn[10:-1]) for name in ("WARC-Record-ID", "WARC-Refers-To")]
        http = source.until(b"\r\n\r\n")
        left = int(fields["Content-Length"]) - len(http)
        kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        digest, total, k, held = hashlib.sha256(), 0, 0, None
        for piece in source.take(left):
            if held is not None:
                yield (ids[0], k, held if with_data else None, len(held), False, None, None, kind, ids[1], None)
                k += 1
            digest.update(piece)
            total += len(piece)
            held = piece
        own = digest.hexdigest()
        fine = kind == "revisit" or (own == told and total == int(fields["X-Payload-Length"]))
        size = int(fields["X-Payload-Length"]) if kind == "revisit" else total
        yield (ids[0], k, (held or b"") if with_data else None, len(held or b""), True, size, told if kind == "revisit" else own, kind, ids[1], fine)
        if source.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError("record is not followed by its separator")


def _reader(folder_scheme: str, with_data: bool):
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)))

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder_scheme)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in chunk_rows(stream, with_data):
                        rows.append(row)
                        size += len(row[2] or b"") + 64
                        if size > 4 * CHUNK:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    return run


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives that a manifest names, one task for each few files."""
    spark = manifest.sparkSession
    spread = manifest.select("path").coalesce(1).repartition(max(1, manifest.count()))
    return spread.mapInArrow(_reader(new_folder(spark, "x"), with_data), CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page what its record says when read back; see the query op10_warc."""
    records = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    read = read_archives(write_archives(records), with_data=False)
    ok = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload digest does not match its record")))
    return read.where("is_last").select("page_id", "payload_bytes", ok.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (
  SELECT page_id, n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY sha256(html)) AS first_id FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM g
"""
