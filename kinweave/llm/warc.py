"""Web archives in ZIP packages: written by tasks, read by ranges without extraction.

A package holds WARC files as stored members under ``archive/`` and an index member ``indexes/index.cdx`` with a line of
JSON for each record: the file, the offset and the length of its own gzip member.  A task writes one package from the pages of its
partition, member by member, as rows of bytes for Spark's text writer, so files go through Spark's commit and any of its
file systems.  The writer ends each row with a newline: between members that is a gap, which the directory skips, and
at the end it is the archive's comment.  All packages carry ZIP64 records.

Reading takes the tail of a file for the end record, follows the ZIP64 locator, reads the central directory, and from it the local headers of
the index members and their lines; the records' ranges are then dealt over the tasks, neighbours read in one piece, each
record cut out and checked against its digest.  Files are opened through pyarrow; where it does not know the file system,
Spark reads a package whole and the ranges are cut from that.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page id is a response; the others
become revisits that name it and carry its HTTP header, but not its payload.

Edge cases: a null payload is empty; a null page id comes after all others, and is read back as null; of repeated ids the rows with
the smallest one are all responses; a null URL is left out, and characters that would break a header line are escaped; a payload
may be as long as a value; an empty table gives no rows; other columns are ignored, whatever they are called.  A package
without an end record, an index line that points outside its file, a record that is no WARC record and a payload that differs from its digest are
errors; deflated members can't be read by ranges, so an index or WARC file that is one is an error, too.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.loop import checkpoint, ensure_checkpoint_dir
from .text import BROADCAST_BYTES, pieces

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100

#: Bytes of a WARC member, of one read, of what a task reads, and of the tail that is read for the end record.
MEMBER_BYTES = 8 << 20
READ_BYTES = 1 << 20
TASK_BYTES = 256 << 20
TAIL_BYTES = 22 + 65535 + 20

#: Shares into which pages with equal payloads are dealt when their digests are joined by a shuffle.
SALTS = 16

#: Bytes that a digest takes in a broadcast table.
DIGEST_BYTES = 128

#: Fixed values of the ZIP format: signatures and layouts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_LAYOUT, CENTRAL_LAYOUT, END_LAYOUT = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"
END64_LAYOUT, LOCATOR64_LAYOUT = "<4sQ2H2L4Q", "<4sLQL"
FULL16, FULL32, MIDNIGHT_1980 = 0xFFFF, 0xFFFFFFFF, (0, 0x21)

#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1980-01-01T00:00:00Z"

#: Index members by name; what is no line of JSON after a key and a time is not an index line.
INDEX = re.compile(r"indexes/.*\.cdxj?$")
INDEX_LINE = re.compile(rb"[^ ]* [^ ]* (\{.*\})")


def revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``(digest, first_id)`` of the payloads that several pages have: the smallest of their ids."""
    payload = F.coalesce(html, F.lit("")).cast("binary")
    seen = pages.where(F.octet_length(payload) >= MIN_REVISIT).select(F.unhex(F.sha2(payload, 256)).alias("digest"), F.col(page_id).alias("first_id"))
    counted = seen.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select("digest", "first_id")


def write_packages(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = BROADCAST_BYTES
) -> None:
    """Write a package for each partition of ``pages`` into a new folder.

    The list of payloads that occur more than once is broadcast if it has been counted to be small; otherwise the pages are
    shuffled by digest, those of one payload in ``SALTS`` shares.
    """
    known = checkpoint(revisits(pages, page_id, html))
    payload = F.coalesce(html, F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest")
    )
    if known.count() * DIGEST_BYTES <= broadcast_bytes:
        joined = rows.join(F.broadcast(known), "digest", "left")
    else:
        shares = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = rows.withColumn("share", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        joined = joined.join(known.withColumn("share", shares), ["digest", "share"], "left")
    other = joined.withColumn("refers_to", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")))
    bodies = other.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_packages, "bytes binary")
    bodies.select(F.col("bytes").cast("string")).write.text(folder)


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of one package, in rows of one member or the directory; nothing for a partition without pages."""
    held, lines, entries, at, names = bytearray(), [], [], 0, 0

    def member(name: str, data: bytes) -> bytes:
        nonlocal at
        crc, label = zlib.crc32(data), name.encode()
        sizes = struct.pack("<2H2Q", 1, 16, len(data), len(data))
        head = struct.pack(LOCAL_LAYOUT, LOCAL, 45, 0, 0, *MIDNIGHT_1980, crc, FULL32, FULL32, len(label), len(sizes)) + label + sizes
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
        flags = (CENTRAL, 45, 45, 0, 0, *MIDNIGHT_1980, crc, FULL32, FULL32, len(label), len(extra), 0, 0, 0, 0, FULL32)
        entries.append(struct.pack(CENTRAL_LAYOUT, *flags) + label + extra)
        at += len(head) + len(data) + 1  # and the newline
        return head + data

    def row(value: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["bytes"])

    for batch in pieces(batches, "payload"):
        for page in batch.to_pylist():
            file = f"data-{names:05d}.warc.gz"
            record = zlib.compress(_record(page), wbits=31)
            place = {"filename": file, "offset": len(held), "length": len(record), "digest": f"sha256:{page['digest'].hex()}"}
            key = page["url"] or "-"
            lines.append(f"{quote(key, safe=':/?#&=%')} {re.sub('[^0-9]', '', DATE)} {json.dumps(place)}\n".encode())
            held += record
            if len(held) >= MEMBER_BYTES:
                yield row(member(f"archive/{file}", bytes(held)))
                held, names = bytearray(), names + 1
    if held:
        yield row(member(f"archive/data-{names:05d}.warc.gz", bytes(held)))
    if lines:
        yield row(member("indexes/index.cdx", b"".join(sorted(lines))))
        directory, n = b"".join(entries), len(entries)
        end64 = struct.pack(END64_LAYOUT, END64, struct.calcsize(END64_LAYOUT) - 12, 45, 45, 0, 0, n, n, len(directory), at)
        locator = struct.pack(LOCATOR64_LAYOUT, LOCATOR64, 0, at + len(directory), 1)
        yield row(directory + end64 + locator + struct.pack(END_LAYOUT, END, FULL16, FULL16, FULL16, FULL16, FULL32, FULL32, 1))


def _record(page: dict) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    payload, number = page["payload"], page["page_id"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    again = page["refers_to"] is not None
    block = http if again else http + payload
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<urn:page:{'' if number is None else number}>"), ("WARC-Date", DATE)]
    if page["url"]:
        fields.append(("WARC-Target-URI", quote(page["url"], safe=":/?#[]@!$&'()*+,;=%")))
    if again:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{page['refers_to']}>")]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{page['digest'].hex()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


Reader = Callable[[int, int], bytes]


class PackageError(ValueError):
    """A file is no package of web archives, or one that cannot be read by ranges."""


def central_directory(read: Reader, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP archive by name: (offset of the local header, bytes, compression method).

    ``read(offset, length)`` gives a range of the archive, whose ``size`` is known.  Bytes before the archive are allowed.
    """
    begin = max(0, size - TAIL_BYTES)
    tail = read(begin, size - begin)
    found = len(tail)
    while (found := tail.rfind(END, 0, found)) >= 0:
        if len(tail) - found >= 22 and struct.unpack_from("<H", tail, found + 20)[0] == len(tail) - found - 22:
            break  # its comment ends where the file does
    if found < 0:
        raise PackageError("no end record")
    _, _, _, _, count, length, offset, _ = struct.unpack_from(END_LAYOUT, tail, found)
    before = begin + found  # where the directory ends, unless ZIP64 records stand between
    if found >= 20 and tail[found - 20 : found - 16] == LOCATOR64:
        _, _, place, _ = struct.unpack_from(LOCATOR64_LAYOUT, tail, found - 20)
        end64 = read(place, 56) if place + 56 <= size else b""
        if end64[:4] != END64:  # offsets count from the archive's begin, which is not the file's
            place = before - 20 - 56
            end64 = read(place, 56)
        if end64[:4] != END64:
            raise PackageError("no ZIP64 end record")
        _, _, _, _, _, _, _, count, length, offset = struct.unpack(END64_LAYOUT, end64)
        before = place
    shift = before - length - offset
    if shift < 0:
        raise PackageError("the directory lies outside the file")
    directory, at, members = read(offset + shift, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise PackageError("the directory ends early")
        fields = struct.unpack_from(CENTRAL_LAYOUT, directory, at)
        method, packed, plain, name_length, extra_length, comment_length, local = (fields[i] for i in (4, 8, 9, 10, 11, 12, 16))
        at += struct.calcsize(CENTRAL_LAYOUT)
        name = directory[at : at + name_length].decode("utf-8" if fields[3] & 0x800 else "cp437" if not directory[at : at + name_length].isascii() else "ascii")
        extra = directory[at + name_length : at + name_length + extra_length]
        at += name_length + extra_length + comment_length
        packed, local = _wide(extra, plain, packed, local)
        members[name] = (local + shift, packed, method)
    return members


def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int]:
    """Packed size and local offset, from the ZIP64 field where the entry's own places are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            if plain == FULL32:
                next(values)
            packed = next(values) if packed == FULL32 else packed
            local = next(values) if local == FULL32 else local
            break
        at += 4 + length
    return packed, local


def data_offset(read: Reader, name: str, member: tuple[int, int, int]) -> int:
    """Where the bytes of a stored member begin."""
    local, _, method = member
    if method != 0:
        raise PackageError(f"{name} is not stored")
    head = read(local, 30)
    if head[:4] != LOCAL:
        raise PackageError(f"{name} has no local header")
    fields = struct.unpack(LOCAL_LAYOUT, head)
    return local + 30 + fields[9] + fields[10]


def index_entries(read: Reader, size: int) -> Iterator[tuple[int, int, str]]:
    """``(offset in the file, bytes, digest)`` of every record that the index members list."""
    members, starts = central_directory(read, size), {}
    for name, member in members.items():
        if not INDEX.fullmatch(name):
            continue
        begin, rest = data_offset(read, name, member), b""
        for at in range(0, member[1], READ_BYTES):
            *whole, rest = (rest + read(begin + at, min(READ_BYTES, member[1] - at))).split(b"\n")
            yield from (_entry(read, members, starts, line) for line in whole if INDEX_LINE.match(line))
        if INDEX_LINE.match(rest):
            yield _entry(read, members, starts, rest)


def _entry(read: Reader, members: dict, starts: dict, line: bytes) -> tuple[int, int, str]:
    place = json.loads(INDEX_LINE.match(line)[1])
    name, offset, length = f"archive/{place['filename']}", int(place["offset"]), int(place["length"])
    if name not in members or offset + length > members[name][1]:
        raise PackageError(f"an index line points outside {name}")
    if name not in starts:
        starts[name] = data_offset(read, name, members[name])
    return starts[name] + offset, length, place.get("digest") or ""


def parse_record(raw: bytes) -> dict:
    """A WARC record: its type, ids, the length and digest that it tells of its payload, and the payload if it has it."""
    head, found, block = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not found:
        raise PackageError("no WARC record")
    fields = _fields(head)
    block = block[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    kind, own = fields["warc-type"], lambda name: (fields.get(name) or "").strip("<>").removeprefix("urn:page:")
    digest, payload = fields["warc-payload-digest"].removeprefix("sha256:"), None
    length = int(_fields(http)["content-length"])
    if kind == "response":
        payload = body
        if len(body) != length or hashlib.sha256(body).hexdigest() != digest:
            raise PackageError(f"the payload of {fields['warc-record-id']} differs from its digest")
    number = lambda text: int(text) if text else None
    return {
        "page_id": number(own("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": number(own("warc-refers-to")),
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": payload,
    }


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_packages(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the packages in a folder, see ``RECORD``; without ``payloads`` that column is null."""
    files = spark.read.format("binaryFile").load(folder)
    try:
        fs.FileSystem.from_uri(_uri(folder))
        files = files.select("path", "length", F.lit(None).cast("binary").alias("content"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        files = files.select("path", "length", "content")
    chunks = files.mapInArrow(_chunks, "path string, content binary, at long, length long, places array<struct<at: long, length: long>>")
    # what a task reads is not what the chunks weigh, so Spark is told how many tasks that takes
    held = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_BYTES))
    dealt = chunks.repartition(tasks, "path", "at")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, rows = batch.slice(i, 1).to_pylist()[0], []
                held = chunk["content"]
                if held is None:
                    with _opened(chunk["path"], None) as read:
                        held = read(chunk["at"], chunk["length"])
                for p in chunk["places"]:
                    raw = held[p["at"] - chunk["at"] : p["at"] - chunk["at"] + p["length"]]
                    rows.append(parse_record(zlib.decompress(raw, wbits=31) if raw[:2] == b"\x1f\x8b" else raw))
                    if not payloads:
                        rows[-1]["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, _RECORD_FIELDS)

    return dealt.mapInArrow(records, RECORD)


_RECORD_FIELDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _uri(path: str) -> str:
    """A path as Spark writes it, with the two slashes that a URI has."""
    return re.sub(r"^file:/+", "file:///", path)


class _opened:
    """``read(offset, length)`` of a file, or of its content where that is given."""

    def __init__(self, path: str, content: bytes | None):
        self.path, self.content, self.file = path, content, None

    def __enter__(self) -> Reader:
        if self.content is not None:
            return lambda offset, length: self.content[offset : offset + length]
        system, path = fs.FileSystem.from_uri(_uri(self.path))
        self.file = system.open_input_file(path)
        return lambda offset, length: self.file.read_at(length, offset)

    def __exit__(self, *_) -> None:
        if self.file is not None:
            self.file.close()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring records of each package, about ``READ_BYTES`` together."""
    place = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())]))
    fields = pa.schema([("path", pa.string()), ("content", pa.binary()), ("at", pa.int64()), ("length", pa.int64()), ("places", place)])

    def chunk(file: dict, some: list[tuple[int, int]]) -> pa.RecordBatch:
        first, last = some[0][0], some[-1][0] + some[-1][1]
        content = None if file["content"] is None else file["content"][first:last]
        own = {"path": file["path"], "content": content, "at": first, "length": last - first, "places": [{"at": a, "length": n} for a, n in some]}
        return pa.RecordBatch.from_pylist([own], fields)

    for batch in batches:
        for i in range(batch.num_rows):
            file = batch.slice(i, 1).to_pylist()[0]
            with _opened(file["path"], file["content"]) as read:
                found = sorted((a, n) for a, n, _ in index_entries(read, file["length"]))
            some: list[tuple[int, int]] = []
            for a, n in found:
                if some and a + n - some[0][0] > READ_BYTES:
                    yield chunk(file, some)
                    some = []
                some.append((a, n))
            if some:
                yield chunk(file, some)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages as packages into the shared checkpoint folder and read their records back, without payloads."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/packages-{uuid.uuid4().hex}"
    write_packages(pages, folder, page_id, url, html)
    return read_packages(spark, folder, payloads=False)
