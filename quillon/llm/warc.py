"""Operator 5: WARC archives, and a normaliser that turns one gzip stream per file into one member per record."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Shelf

EOL = b"\r\n"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "<urn:page:{}>"
INDEX = pa.schema([("archive", pa.string()), ("record_no", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])
INDEX_SCHEMA = "archive string, record_no long, offset long, length long, record_id string, record_type string"
READ_SCHEMA = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, sha: str, refers_to=None, revisit: bool = False) -> bytes:
    """One uncompressed record. A revisit has no payload of its own: it names the digest and length of what it repeats."""
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", RECORD_ID.format("" if page_id is None else page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers.append(("WARC-Payload-Digest", f"sha1:{sha}"))
    headers.append(("X-Payload-Length", str(len(payload))))
    if revisit:
        headers += [("WARC-Refers-To", RECORD_ID.format(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = b"" if revisit else payload
    headers.append(("Content-Length", str(len(body))))
    return VERSION + EOL + b"".join(f"{k}: {v}".encode() + EOL for k, v in headers) + EOL + body + EOL + EOL


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(EOL + EOL)
    lines = head.split(EOL)
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def store_of(uri: str):
    return pafs.FileSystem.from_uri(uri)


def attempt_name(prefix: str) -> str:
    """A file name no other attempt of any task uses; only names that Spark commits are ever read."""
    c = TaskContext.get()
    return f"{prefix}-{c.partitionId():06d}-{c.taskAttemptId()}-{os.urandom(4).hex()}.warc.gz"


def inflate(stream, step: int = 1 << 18) -> Iterator[bytes]:
    """Bytes of a gzip file in one pass, whether it holds one member or many."""
    member = zlib.decompressobj(31)
    while data := stream.read(step):
        while data:
            yield member.decompress(data)
            data = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)
    yield member.flush()


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of bytes; memory holds one record and one chunk."""
    buf = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        for chunk in chunks:
            if chunk:
                buf.extend(chunk)
                return True
        return False

    while True:
        end, seen = -1, 0
        while (end := buf.find(EOL + EOL, seen)) < 0:
            seen = max(0, len(buf) - 3)
            if not more():
                if bytes(buf).strip():
                    raise ValueError("the archive ends inside a record")
                return
        length = 0
        for line in bytes(buf[:end]).split(EOL)[1:]:
            if line.lower().startswith(b"content-length:"):
                length = int(line.split(b":", 1)[1])
        whole = end + 4 + length + 4
        while len(buf) < whole:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(buf[:whole])
        del buf[:whole]


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds __revisit and __first: of rows with equal payloads of ``least_bytes`` or more, all but the smallest page_id revisit it.

    Only (page_id, digest, length) is grouped and joined, with partial minima before the shuffle, so a payload that a
    third of the pages share is one small row per task. Rows repeated with the smallest page_id are all responses; a
    row without page_id refers to the smallest page_id of its payload, and is a response if there is none.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("n", F.length("payload"))
    groups = keyed.filter(F.col("n") >= least_bytes).groupBy(F.col("sha").alias("sha_"), F.col("n").alias("n_")).agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    groups = groups.filter("rows > 1 and first is not null")
    joined = keyed.join(groups, (F.col("sha") == F.col("sha_")) & (F.col("n") == F.col("n_")), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.coalesce(other, F.lit(False)).alias("__revisit"), F.when(other, F.col("first")).alias("__first"))


def write_monolithic(marked: DataFrame, folder: str, roll_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write the rows as archives of one gzip stream each; returns (archive, records) per committed file.

    A task starts a new file when ``roll_bytes`` of records are in the current one.
    """

    def run(batches):
        fs, base = store_of(folder)
        fs.create_dir(base, recursive=True)
        out, packer, name, size, count, done = None, None, None, 0, 0, []

        def close():
            out.write(packer.flush())
            out.close()
            done.append((f"{folder}/{name}", count))

        for batch in batches:
            ids, urls, payloads, flags, firsts = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    name, size, count = attempt_name("mono"), 0, 0
                    out, packer = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = payloads[i].as_py()
                raw = record(ids[i].as_py(), urls[i].as_py(), payload, digest(payload), firsts[i].as_py(), flags[i].as_py())
                out.write(packer.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return marked.mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Inflate each archive once, rewrite every record as its own gzip member, and return the offset index.

    The archive is streamed: a task holds one record. The index (archive, record_no, offset, length, record_id,
    record_type) is the result, and is also written beside each new archive as a sidecar ``.idx.parquet``.
    """
    import pyarrow.parquet as pq

    def run(batches):
        fs, base = store_of(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                sfs, spath = store_of(source)
                name = attempt_name("norm")
                rows, at = [], 0
                with sfs.open_input_stream(spath, compression=None) as stream, fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for raw in split_records(inflate(stream)):
                        head = parse(raw)[0]
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        rows.append((f"{folder}/{name}", len(rows), at, len(member), head["WARC-Record-ID"], head["WARC-Type"]))
                        at += len(member)
                index = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)] if rows else [pa.array([], f.type) for f in INDEX], schema=INDEX)
                pq.write_table(index, f"{base}/{name}.idx.parquet", filesystem=fs)
                yield from index.to_batches()

    return archives.select("archive").mapInArrow(run, INDEX_SCHEMA)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records by the offset index: seek, inflate one member, parse. Rows of one archive should be neighbours in order of offset."""

    def number(text: str | None):
        inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner else None

    def run(batches):
        held, stream = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != held:
                    fs, path = store_of(archive)
                    held, stream = archive, fs.open_input_file(path)
                head, body = parse(zlib.decompress(stream.read_at(length, offset), 31))
                sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and digest(body) != sha:
                    raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                rows.append((archive, offset, number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), sha, head["WARC-Type"], number(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), body if payloads else None))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=[c.split()[0] for c in READ_SCHEMA.split(", ")])

    return index.select("archive", "offset", "length").mapInArrow(run, READ_SCHEMA)


def archive_pages(pages: DataFrame, least_bytes: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write pages (page_id, url, html) as WARC records, normalise the archives and return the offset index.

    A null html is an empty payload; an empty payload takes part in revisits like any other when ``least_bytes`` is 0;
    a null url leaves its header out; other columns are not written. An empty table gives an empty index.
    """
    shelf = Shelf(pages.sparkSession)
    mono = shelf.folder("mono")
    archives = shelf.put(write_monolithic(revisits(pages, least_bytes), mono, roll_bytes), "archives")
    index = shelf.put(normalise(archives.repartition(max(1, archives.count())), shelf.folder("warc")), "index")
    shelf.remove(mono)
    return index
