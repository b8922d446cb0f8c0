"""WARC archives compressed with Zstandard: a writer, and a reader that takes one frame per record.

An archive starts with a skippable frame (magic number 0x184D2A5D) that holds the dictionary; every record then is a Zstandard
frame of its own, compressed with that dictionary. An archive is bounded in size, so it is one value of a binary column: the
reader takes (path, content) as ``spark.read.format("binaryFile")`` gives them, or as `write_archives` makes them.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.session import cut_lineage

# Fixed values of the two formats.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"

#: Payloads shorter than this are stored again rather than referred to.
MIN_REVISIT = 100
#: Uncompressed bytes after which the writer starts another archive.
ARCHIVE_BYTES = 8_000_000
#: Bytes of the first records from which an archive's dictionary is trained, and the dictionary's size.
SAMPLE_BYTES, DICT_BYTES = 1_000_000, 16_384
#: The largest record that the reader unpacks.
MAX_RECORD = 1 << 30


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary; null html: empty), digest (SHA-256, hex), refers_to.

    Of rows with equal payloads of at least ``MIN_REVISIT`` bytes those with the smallest page_id are originals (null), the rest
    refer to it. A group with null ids alone has no revisits.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    many = own.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = own.join(many.select("digest", "first"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return out.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record; or, with ``refers_to``, a revisit record: the HTTP header of the full payload without its body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """An archive of these records: the dictionary's frame and a frame for each record."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[:SAMPLE_BYTES])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too few or too short records: their bytes serve as a plain dictionary
        trained = b"".join(sample)[:DICT_BYTES]
    trained = trained if len(trained) >= 8 else VERSION
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    return struct.pack("<II", DICT_MAGIC, len(trained)) + trained + b"".join(map(packer.compress, records))


def write_archives(pages: DataFrame) -> DataFrame:
    """path, content: archives of the rows of `with_originals`, a new one after ``ARCHIVE_BYTES``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            content = archive(held)
            name = f"{hashlib.sha256(content).hexdigest()}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                held.append(record(*(v.as_py() for v in row)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, content binary")


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each from its own frame."""
    if len(content) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack_from("<II", content)
    if magic != DICT_MAGIC or 8 + size > len(content):
        raise WarcError("no dictionary in a leading skippable frame")
    trained = content[8 : 8 + size]
    if trained[:4] == ZSTD_MAGIC:
        trained = zstandard.ZstdDecompressor().decompress(trained, max_output_size=MAX_RECORD)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    rest = memoryview(content)[8 + size :]
    step = 1 << 16
    while len(rest):
        one, out, at = reader.decompressobj(), [], 0
        total = 0
        while not one.eof:
            if at >= len(rest):
                raise WarcError("the last frame is cut off")
            try:
                out.append(one.decompress(rest[at : at + step]))
            except zstandard.ZstdError as e:
                raise WarcError(f"broken frame: {e}") from e
            total += len(out[-1])
            if total > MAX_RECORD:
                raise WarcError("a record is too long")
            at += step
        rest = rest[min(at, len(rest)) - len(one.unused_data) :]
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record. Raises WarcError where a field or a length is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (VERSION, b"WARC/1.0"):
        raise WarcError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[name.decode("ascii").lower()] = value.strip().decode("utf-8", "surrogatepass")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise WarcError(f"no {need}")
    if not re.fullmatch(r"[0-9]+", fields["content-length"]):
        raise WarcError("bad content-length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes where {n} are announced")
    return fields, rest[:n]


def payload_of(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Length of the full payload, and the payload (None in a revisit). Both are held against the record's own digest."""
    http, sep, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
    if not sep or not m:
        raise WarcError("no HTTP header with a content-length")
    n = int(m[1])
    if fields["warc-type"] == "revisit":
        if body:
            raise WarcError("a revisit with a body")
        return n, None
    if len(body) != n:
        raise WarcError(f"body of {len(body)} bytes where {n} are announced")
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(body).hexdigest():
        raise WarcError("the payload doesn't match its digest")
    return n, body


READ = "path string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of (path, content): ids, type, payload length and digest, payload, error.

    A record that fails its checks is a row with ``error`` and nulls; an archive whose frames can't be followed further
    gives one such row in place of the rest. ``payloads`` False leaves the payload column null.
    """
    schema = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def rows(path: str, content: bytes) -> Iterator[dict]:
        try:
            for raw in frames(content):
                try:
                    f, block = parse(raw)
                    n, body = payload_of(f, block)
                    digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or (hashlib.sha256(body).hexdigest() if body is not None else None)
                    ids = {k: int(f[h]) if h in f else None for k, h in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page-id"))}
                    yield {"path": path, **ids, "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "payload_bytes": n, "payload_digest": digest, "payload": body if payloads else None, "error": None}
                except (WarcError, ValueError) as e:
                    yield {"path": path, "error": str(e)}
        except WarcError as e:
            yield {"path": path, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for r in rows(path.as_py(), content.as_py() or b""):
                    held.append(r)
                    size += len(r.get("payload") or b"")
                    if len(held) >= 2000 or size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return archives.select("path", "content").mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and reads them back; every record has to be right.

    A null html is an empty payload, a null url or page_id leaves its field out. A repeated row is written again; a row
    with the smallest page_id of its payload is a response, also when repeated. An empty table gives no archive and no row.
    """
    archives = cut_lineage(write_archives(with_originals(pages)))
    back = read_archives(archives, payloads=False)
    right: Column = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("string"))
    return back.select("page_id", "payload_bytes", "payload_digest", right.alias("record_type"), "refers_to")
