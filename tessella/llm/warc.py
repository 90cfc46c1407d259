"""WARC archives: records for pages, and the normaliser of whole-file gzip streams.

``write_archives`` lays pages out as WARC/1.1 records in archives that are one gzip stream each, as crawlers without
per-record compression leave them. ``normalise`` inflates such a stream once, from front to back, writes every record
again as a gzip member of its own, and returns the sidecar index (offset and length of each member), by which a single
record can be read. ``read_records`` reads archives back through that index.

An archive is a row of a table (name, content), so that Spark's committed writers carry it to any store and a lost
executor leaves no half-written file; ``export`` lays the rows out as files. Archives are cut at ARCHIVE bytes of
payload, a longer record has one of its own.

Of pages with equal payloads of at least REVISIT bytes the one with the largest page_id is the response and the others
revisit it. Rows that repeat this largest id are responses each. Null html is an empty payload; an empty table gives
an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, materialise

REVISIT = 1000
ARCHIVE = 4 << 20
DATE = "2024-01-01T00:00:00Z"  # of capture, which the pages do not carry
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "archive string, content binary"
_ARCHIVES = pa.schema([("archive", pa.string()), ("content", pa.binary())])
NORMAL = "archive string, content binary, offsets array<long>, lengths array<long>"
_NORMAL = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long"
_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64())]
)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has no payload; its headers say how long that was and what its digest is."""
    name = "" if page_id is None else page_id
    uri = " ".join(url.split()).replace(" ", "%20") or "about:blank"
    head = [f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def roles(pages: DataFrame) -> DataFrame:
    """pages with digest and refers_to. The aggregate combines before it shuffles; the join's hot digests are split."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), (F.octet_length(payload) >= REVISIT).alias("large"))
    first = keyed.where("large").groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "leader")
    joined = keyed.join(first, F.col("large") & (F.col("digest") == F.col("d")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("leader") != F.coalesce("page_id", F.lit(-1) - F.col("leader")), F.col("leader")).alias("refers_to"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    deflate, out, held = None, [], 0

    def close():
        out.append(deflate.flush())
        return batch(_ARCHIVES, archive=[f"part-{part:06d}-{k:05d}.warc.gz"], content=[b"".join(out)])

    for b in batches:
        for r in range(b.num_rows):
            page, url, html, digest, refers = (c[r].as_py() for c in b.columns)
            if deflate is None:
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.append(deflate.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:info>\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
            raw = record(page, url or "", (html or "").encode(), digest, refers)
            out.append(deflate.compress(raw))
            held += len(raw)
            if held >= ARCHIVE:
                yield close()
                deflate, out, held, k = None, [], 0, k + 1
    if deflate is not None:
        yield close()


def write_archives(placed: DataFrame) -> DataFrame:
    """(archive, content): monolithic gzip archives of the pages of each partition, as a written table."""
    return materialise(placed.mapInArrow(_pack, ARCHIVES), "warc")


def inflate(content: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The plain bytes of one gzip stream, or of several members in a row, inflated once from front to back."""
    machine, at = zlib.decompressobj(31), 0
    while at < len(content) or machine.unconsumed_tail:
        data = machine.unconsumed_tail or content[at : at + step]
        at += 0 if machine.unconsumed_tail else step
        yield machine.decompress(data, step)
        while machine.eof and (machine.unused_data or at < len(content)):
            rest = machine.unused_data
            machine = zlib.decompressobj(31)
            if not rest:
                break
            yield machine.decompress(rest, step)
    yield machine.flush()
    if content and not machine.eof:
        raise ValueError("the archive ends within a gzip member")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, head, block and the two line ends after it, of a stream; a record is held, never the stream."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while True:
            head = held.find(b"\r\n\r\n")
            if head < 0:
                break
            size = next(int(x.split(b":", 1)[1]) for x in bytes(held[:head]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            end = head + 4 + size + 4
            if len(held) < end:
                break
            yield bytes(held[:end])
            del held[:end]
    if held.strip():
        raise ValueError("the archive ends within a record")


def normalise_one(content: bytes) -> tuple[bytes, list[int], list[int]]:
    """(content with a member per record, offsets, lengths)."""
    out, offsets, lengths, at = [], [], [], 0
    for rec in split_records(inflate(content)):
        member = gzip.compress(rec, 1, mtime=0)
        out.append(member)
        offsets.append(at)
        lengths.append(len(member))
        at += len(member)
    return b"".join(out), offsets, lengths


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            content, offsets, lengths = normalise_one(b.column(1)[r].as_py())
            yield batch(_NORMAL, archive=[b.column(0)[r].as_py()], content=[content], offsets=[offsets], lengths=[lengths])


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content, offsets, lengths): each record a member of its own, and where each one lies."""
    return materialise(archives.select("archive", "content").mapInArrow(_normalise, NORMAL), "warc-members")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, payload without the HTTP head)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(uri: str | None) -> int | None:
    name = (uri or "")[len("<urn:page:") : -1]
    return int(name) if name else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            archive, content, offsets, lengths = (c[r].as_py() for c in b.columns)
            rows = {f.name: [] for f in _RECORDS}
            for at, size in zip(offsets, lengths, strict=True):
                fields, payload = parse(gzip.decompress(content[at : at + size]))
                if fields["warc-type"] == "warcinfo":
                    continue
                digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
                    raise ValueError(f"{archive} at {at}: the payload does not fit its digest")
                for k, v in zip(rows, (_page(fields["warc-record-id"]), n, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields["warc-target-uri"], archive, at), strict=True):
                    rows[k].append(v)
            yield batch(_RECORDS, **rows)


def read_records(normal: DataFrame) -> DataFrame:
    """A row per record, found through the sidecar index; responses are held against their digests."""
    return normal.select("archive", "content", "offsets", "lengths").mapInArrow(_read, RECORDS)


def export(normal: DataFrame, folder: str) -> DataFrame:
    """Write each archive and its index (.idx: offset and length, a line a record) as files into a shared folder; returns their names."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            names = []
            for r in range(b.num_rows):
                name, content, offsets, lengths = (c[r].as_py() for c in b.columns)
                for suffix, data in (("", content), (".idx", "".join(f"{a} {n}\n" for a, n in zip(offsets, lengths, strict=True)).encode())):
                    with store.open_output_stream(f"{top}/.{name}{suffix}.part") as f:
                        f.write(data)
                    store.move(f"{top}/.{name}{suffix}.part", f"{top}/{name}{suffix}")
                names.append(f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    return normal.select("archive", "content", "offsets", "lengths").mapInArrow(put, "path string")


def op5_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_records(normalise(write_archives(roles(spark.read.parquet(f"{sf_dir}/pages.parquet")))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
