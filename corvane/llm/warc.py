"""WARC archives: writing, normalising monolithic gzip files, and reading back by offset.

A monolithic archive is one gzip stream over all records, which can't be entered in the middle.
The normaliser inflates that stream once, a megabyte at a time, rewrites each record as a gzip
member of its own, and writes a sidecar index of the members' offsets. Records are then read by
seeking. Files are written under a name of the attempt and renamed at the end, so a lost
executor leaves no half file under a final name, and the tasks give back only names and offsets.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import hot
from corvane.runtime import materialise, scratch_dir, ship, table

LEAST_SHARED, PIECE = 100, 1 << 20
_DATE = "2026-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    """A record is named by its page and its payload; a page without an id by the payload alone."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def record(page_id: int | None, url: str, payload: bytes, kind: str, digest: str, size: int, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but the identity of the record that has it."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, digest)}"]
        payload = b""
    body = head + payload
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def _one_line(url: str | None) -> str:
    return " ".join((url or "about:blank").split()) or "about:blank"


def records(pieces):
    """Whole records out of an iterator of inflated bytes; holds one record and a piece at a time."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(held[:end]).decode("utf-8", "replace")
                if not head.startswith("WARC/"):
                    raise ValueError(f"no WARC record at {head[:40]!r}")
                length = next(int(x.partition(":")[2]) for x in head.split("\r\n") if x.lower().startswith("content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def inflate(stream):
    """Inflated pieces, of PIECE bytes at most, of a gzip stream of one member or many; a stream that is cut short raises."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(PIECE):
        while data:
            begun = True
            yield z.decompress(data, PIECE)
            data = z.unused_data if z.eof else z.unconsumed_tail
            if z.eof:
                z, begun = zlib.decompressobj(31), False
    while begun:  # what the limit has held back
        piece = z.decompress(b"", PIECE)
        if not piece and not z.eof:
            raise ValueError("the archive's compressed stream is cut short")
        begun = not z.eof
        yield piece


def parse(raw: bytes) -> dict:
    """Fields of one record; the digest is computed from the payload where there is one."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    http, _, payload = body[: int(fields["content-length"])].partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    said = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].partition(":")[2]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != said):
        raise ValueError(f"record {fields['warc-record-id']} does not hold what its header says")
    page = lambda x: int(p) if (p := x.strip("<>").split(":")[2]) else None
    return {
        "page_id": page(fields["warc-record-id"]), "payload_bytes": said, "payload_digest": digest, "record_type": kind,
        "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None, "url": fields["warc-target-uri"],
    }


def _place(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _commit(fs, temp: str, final: str) -> None:
    """Give a file its final name; where a file system doesn't replace, that of an earlier attempt goes first."""
    try:
        fs.move(temp, final)
    except OSError:
        fs.delete_file(final)
        fs.move(temp, final)


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, size, kind, refers_to): which record each page becomes.

    What a page becomes is settled on digests alone; the payloads are moved once, to where their page's decision is. Null html is
    empty; a page with a null id is never referred to but may revisit another; repeated rows stay.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    ids = materialise(rows.select("page_id", "digest", "size").distinct(), "page-digests")
    shared = ids.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).where("m > 1")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    named = F.struct(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0))).alias("named")
    told = hot.join(ids, shared, "digest", "m", ids.count(), "left").select(named, "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))
    return rows.withColumn("named", F.struct(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)))).join(told, ["named", "digest"]).drop("named")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of one gzip stream each below ``folder``, one for a task; returns (file, records).

    Each row becomes a record, also one with a null page_id; different payloads under one page_id have records of different names, and
    repeated rows repeat their record. An empty table writes nothing; extra columns are not read.
    """
    ship(pages.sparkSession)
    columns = ("page_id", "url", "html", "digest", "size", "kind", "refers_to")

    def run(batches):
        fs, top = _place(folder)
        fs.create_dir(top)
        name, temp, n, out, raw = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", f"{top}/.{uuid.uuid4().hex}", 0, None, None
        for b in batches:
            for k in range(b.num_rows):
                page, url, html, digest, size, kind, refers = (b.column(c)[k].as_py() for c in range(len(columns)))
                if out is None:
                    raw = fs.open_output_stream(temp, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0)
                out.write(record(page, url, html.encode("utf-8", "surrogatepass"), kind, digest, size, refers))
                n += 1
        if out is not None:
            out.close()
            raw.close()
            _commit(fs, temp, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return plan_records(pages).select(*columns).mapInArrow(run, "file string, records long")


def normalise(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrite each archive (column file, below ``folder``) to ``target`` with one member for a record
    and a sidecar index beside it; returns the index: (file, offset, length). No archives give no index; one that is cut short raises."""
    ship(archives.sparkSession)

    def run(batches):
        fs, top = _place(folder)
        fs2, to = _place(target)
        fs2.create_dir(to)
        for b in batches:
            for name in b.column(0).to_pylist():
                temp, at, index = f"{to}/.{uuid.uuid4().hex}", 0, []
                with fs.open_input_stream(f"{top}/{name}", compression=None) as src, fs2.open_output_stream(temp, compression=None) as dst:
                    for raw in records(inflate(src)):
                        member = gzip.compress(raw, 6, mtime=0)
                        dst.write(member)
                        index.append((at, len(member)))
                        at += len(member)
                side = f"{to}/.{uuid.uuid4().hex}"
                with fs2.open_output_stream(side, compression=None) as f:
                    for o, n in index:
                        f.write(json.dumps({"file": name, "offset": o, "length": n}).encode() + b"\n")
                _commit(fs2, temp, f"{to}/{name}")
                _commit(fs2, side, f"{to}/{name}.idx")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(index), pa.string()), pa.array([o for o, _ in index], pa.int64()), pa.array([n for _, n in index], pa.int64())], names=["file", "offset", "length"])

    return archives.select("file").mapInArrow(run, "file string, offset long, length long")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("file string, offset long, length long").option("pathGlobFilter", "*.idx").json(target)


def read_records(index: DataFrame, target: str, payloads: bool = False) -> DataFrame:
    """The records that ``index`` (file, offset, length) names, each read by seeking to its member; page_id may be null."""
    ship(index.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    types = dict(page_id=pa.int64(), payload_bytes=pa.int64(), payload_digest=pa.string(), record_type=pa.string(), refers_to=pa.int64(), payload=pa.binary())

    def run(batches):
        fs, top = _place(target)
        name, src = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["file"] != name:
                    if src:
                        src.close()
                    name, src = r["file"], fs.open_input_file(f"{top}/{r['file']}")
                src.seek(r["offset"])
                rows.append(parse(gzip.decompress(src.read(r["length"]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], types[n]) for n in names], names=names)
        if src:
            src.close()

    return index.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and read all records back by their index.

    A row comes back for each row, null ids and repeated rows included; null and empty html is an empty payload.
    """
    written = materialise(write_monolithic(pages, f"{folder}/whole"), "archives")
    files = max(1, written.count())
    index = materialise(normalise(written.repartition(files, "file"), f"{folder}/whole", f"{folder}/members"), "index")
    return read_records(index.repartition(files, "file").sortWithinPartitions("file", "offset"), f"{folder}/members")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``pages``, read back from the archives."""
    return round_trip(table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
