"""WARC archives: a writer with deduplicated payloads and a sequential reader.

Archives are files of gzip members, one member a record. Tasks write them next to each other in the shared folder;
a table of (path, records) is written once and fixes which files count, so the files of a lost or repeated task attempt
are never read. The reader takes an archive from its start to its end in small blocks: zlib decompresses one member
after the other, Content-Length frames the record, and the digests of block and payload are verified.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, small, table
from .textnp import column

#: Equal payloads of fewer bytes are all stored.
MIN_REVISIT = 100
#: Bytes after which a task starts its next archive, and bytes read at a time.
ROLL = 64 << 20
BLOCK = 256 << 10
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive that isn't well formed, or a digest that doesn't hold."""


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header but no payload."""
    block = _HTTP.format(len(payload)).encode() + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page: {refers_to}",
                 f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, str(refers_to))}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, in order; never more than one member and one block in memory."""
    data = b""
    while True:
        data = data or stream.read(block)
        if not data:
            return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data and not (data := stream.read(block)):
                raise WarcError("the archive ends within a gzip member")
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            data = z.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """The fields of RECORD from one record; raises WarcError if framing or a digest is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    field = dict(line.split(": ", 1) for line in lines[1:])
    n = int(field["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the block")
    if field["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise WarcError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("payload digest or length differs")
    number = lambda k: int(field[k]) if field.get(k, "None") != "None" else None
    return {
        "page_id": number("Page-ID"), "url": unquote(field["WARC-Target-URI"]) if "WARC-Target-URI" in field else None, "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": number("Refers-To-Page"), "payload": payload if kind == "response" else None,
    }


def roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (text), digest, kind, refers_to of every row of ``pages``."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("digest"))
    firsts = rows.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    firsts = Workspace(pages.sparkSession, "warc").write(firsts.where("copies > 1").select(F.col("digest").alias("of"), "first"), "firsts")
    # Ids go to the payloads, not payloads to the digests: a payload that many pages share would be a hot key.
    few = small(firsts)
    if few is not firsts:
        out = rows.join(few, F.col("digest") == F.col("of"), "left")
    else:
        later = rows.select(F.col("page_id").alias("id"), "digest").join(firsts, F.col("digest") == F.col("of")).select("id", "of", "first").distinct()
        out = rows.join(later, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return out.select("page_id", "url", "payload", "digest", kind.alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, level: int = 6, roll: int = ROLL) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) to archives in ``folder``; returns (path, n_records, n_bytes).

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of ``min_revisit`` bytes or more, that
    with the smallest page_id is a response and the others revisit it; where several rows share that page_id all of them
    are responses. A null page_id comes after all others. An empty table writes no archive. ``folder`` is a URI that every executor reaches. The result has
    side effects when it runs: write it to a table once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, records, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [records], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, payload, digest, kind, refers in zip(*(column(batch, c) for c in ("page_id", "url", "payload", "digest", "kind", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, records, size = fs.open_output_stream(f"{root}/{name}"), f"{folder.rstrip('/')}/{name}", 0, 0
                raw = record(page_id.as_py(), url.as_py(), payload.as_py().encode(), digest.as_py(), kind.as_py(), refers.as_py())
                out.write(gz := member(raw, level))
                records, size = records + 1, size + len(gz)
                if size >= roll:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return roles(pages, min_revisit).mapInArrow(run, "path string, n_records long, n_bytes long")


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records (see RECORD) of the archives in the column ``path``; each archive is read by one task, from start to end.

    Raises WarcError on a broken member, a wrong length or digest, or (with a column ``n_records``) missing records.
    """
    spark = archives.sparkSession
    counted = "n_records" in archives.columns
    want = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["path"])
                seen, rows, held = 0, [], 0
                with fs.open_input_stream(path, buffer_size=0) as stream:
                    for raw in members(stream):
                        rows.append(got := parse(raw))
                        seen, held = seen + 1, held + len(raw)
                        if not payloads:
                            got["payload"] = None
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if counted and seen != row["n_records"]:
                    raise WarcError(f"{row['path']} has {seen} records, not {row['n_records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.repartition(want, F.xxhash64("path")).mapInArrow(run, RECORD)


def op5_warc(spark, sf_dir):
    ws = Workspace(spark, "warc")
    archives = ws.write(write_warc(table(spark, sf_dir, "pages"), f"{ws.path}/archives"), "manifest")
    return read_warc(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
