"""WARC records in ZIP packages: written by Spark tasks, read back record by record.

A package is a ZIP file whose members are stored, not compressed: archives in ``archive/`` with one gzip member per record,
and indexes in ``indexes/``, a line with archive, place and length for each record. The writer makes one of each. The reader parses the end record, the
ZIP64 records where they are needed, and the central directory, then reads the indexes and single records by their byte
ranges; nothing is unpacked to disk. Files are opened through the file system of their URI, so any shared store will do.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm.common import cut, scratch, slices, whole

ARCHIVES, INDEX_ENDINGS = "archive/", (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")
#: The members that the writer makes.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are stored with every record.
LEAST_REVISIT = 100
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# --- records --------------------------------------------------------------------------------------


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """A WARC record. A revisit carries the digest of the payload it refers to, and no payload."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Headers and payload of one record; the lengths of block and payload are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(v) if (v := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": page("warc-record-id"), "record_type": fields["warc-type"], "url": fields["warc-target-uri"],
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "refers_to": page("warc-refers-to"),
        "payload": None if fields["warc-type"] == "revisit" else payload,
    }


# --- packages -------------------------------------------------------------------------------------


class Writer:
    """Writes a ZIP of stored members to a stream that only goes forward; sizes follow each member's data.

    Every member's directory entry has ZIP64 sizes with ``zip64``; else only where a number needs them.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.entries, self.zip64 = out, 0, [], zip64

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> None:
        start, crc, size, raw = self.at, 0, 0, name.encode()
        # Bit 3: CRC and sizes stand behind the data. The ZIP64 field announces 8-byte sizes there.
        self.put(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))
        for part in parts:
            self.put(part)
            crc, size = zlib.crc32(part, crc), size + len(part)
        self.put(struct.pack("<4sI2Q", b"PK\x07\x08", crc, size, size))
        self.entries.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            large = [self.zip64 or size >= FULL32, self.zip64 or at >= FULL32]
            extra = (struct.pack("<2Q", size, size) if large[0] else b"") + (struct.pack("<Q", at) if large[1] else b"")
            extra = struct.pack("<2H", 1, len(extra)) + extra if extra else b""
            short = FULL32 if large[0] else size
            self.put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 8, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, FULL32 if large[1] else at) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if self.zip64 or max(start, size) >= FULL32 or n >= FULL16:
            end = self.at
            self.put(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
            start, size, n = FULL32, FULL32, FULL16
        self.put(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, n, n, size, start, 0))


@dataclass(frozen=True)
class Member:
    """A stored member: where its data lie in the package."""

    name: str
    start: int
    size: int


def members(file) -> dict[str, Member]:
    """The central directory of an open package: stored members by name."""

    def at(place: int, n: int) -> bytes:
        file.seek(place)
        return file.read(n)

    whole_size = file.size()
    tail_at = max(0, whole_size - 22 - FULL16)
    tail = at(tail_at, whole_size - tail_at)
    # The end record's comment reaches exactly to the end of the file.
    found = next((i for i in range(len(tail) - 22, -1, -1) if tail[i : i + 4] == b"PK\x05\x06" and i + 22 + int.from_bytes(tail[i + 20 : i + 22], "little") == len(tail)), -1)
    if found < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack("<H2I", tail[found + 10 : found + 20])
    if FULL32 in (size, start) or n == FULL16:
        locator = at(tail_at + found - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = at(int.from_bytes(locator[8:16], "little"), 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        n, size, start = struct.unpack("<3Q", end[32:56])
    directory, i, out = at(start, size), 0, {}
    for _ in range(n):
        if directory[i : i + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, real, name_len, extra_len, note_len, place = *struct.unpack("<H", directory[i + 10 : i + 12]), *struct.unpack("<2I3H", directory[i + 20 : i + 34]), *struct.unpack("<I", directory[i + 42 : i + 46])
        name, extra = directory[i + 46 : i + 46 + name_len].decode(), directory[i + 46 + name_len : i + 46 + name_len + extra_len]
        i += 46 + name_len + extra_len + note_len
        while len(extra) >= 4:
            tag, length = struct.unpack("<2H", extra[:4])
            if tag == 1:  # 8-byte values, only of the fields that are full, in this order
                values = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                real = next(values) if real == FULL32 else real
                packed = next(values) if packed == FULL32 else packed
                place = next(values) if place == FULL32 else place
            extra = extra[4 + length :]
        if method != 0:
            continue  # only stored members can be read by ranges
        local = at(place, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        out[name] = Member(name, place + 30 + sum(struct.unpack("<2H", local[26:30])), real)
    return out


def index_lines(file, index: Member, most: int = 1 << 20) -> Iterator[bytes]:
    """The lines of an index, plain or of gzip members, read in pieces of ``most`` bytes."""
    done, rest = 0, b""
    packed = index.name.endswith(".gz")
    unpacker = zlib.decompressobj(31)
    while done < index.size:
        file.seek(index.start + done)
        piece = file.read(min(most, index.size - done))
        done += len(piece)
        while piece:
            if packed:
                text = unpacker.decompress(piece, most)
                piece = unpacker.unconsumed_tail
                if unpacker.eof:
                    piece, unpacker = unpacker.unused_data, zlib.decompressobj(31)
            else:
                text, piece = piece, b""
            *lines, rest = (rest + text).split(b"\n")
            yield from lines
    yield rest


def records(file, most: int = 1 << 20) -> Iterator[dict]:
    """The records of an open package, index by index in the order of their names and lines.

    Every stored index of the folder ``indexes`` is read, and each line's record from the member of the folder ``archive``
    that its ``filename`` names. Empty lines and those that begin with ``!`` describe no record. An index that names a member
    which is absent or not stored, or a place behind its end, is an error.
    """
    found = members(file)
    for index in sorted(found.values(), key=lambda m: m.name):
        if not index.name.startswith("indexes/") or not index.name.endswith(INDEX_ENDINGS):
            continue
        for line in index_lines(file, index, most):
            if not line.strip() or line.startswith(b"!"):
                continue
            entry = json.loads(line[line.index(b"{") :])
            archive = found.get(ARCHIVES + entry["filename"].removeprefix(ARCHIVES))
            if archive is None:
                raise ValueError(f"{index.name} names {entry['filename']}, which is not a stored member")
            offset, length = int(entry["offset"]), int(entry["length"])  # some writers quote them
            if offset + length > archive.size:
                raise ValueError(f"{index.name} points behind {archive.name}")
            file.seek(archive.start + offset)
            yield parsed(zlib.decompress(file.read(length), 31))


def opened(uri: str):
    """File system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


# --- jobs -----------------------------------------------------------------------------------------


def planned(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, first``: the smallest id among rows with the same payload, null for short payloads."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), whole("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= LEAST_REVISIT
    first = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"))
    return rows.join(first, "digest", "left")


def write_packages(rows: DataFrame, folder: str, package_bytes: int = 64 << 20, zip64: bool = False) -> DataFrame:
    """Write the planned rows as packages in ``folder``; returns the manifest ``package, records``.

    Each task writes packages of about ``package_bytes`` of payload, one record at a time. A package is written under a
    name of the attempt and then renamed, so a task that runs again replaces its files. A row is a revisit if another row
    holds its payload with a smaller id.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        queue = (row for part in slices(batches, "html") for row in zip(*(c.to_pylist() for c in part.columns)))
        head, number = next(queue, None), 0
        while head is not None:
            lines, at, count = [], 0, 0

            def parts() -> Iterator[bytes]:
                nonlocal head, at, count
                payload_bytes = 0
                while head is not None and payload_bytes < package_bytes:
                    page_id, url, html, digest, first = head
                    payload = html.encode()
                    again = first is not None and page_id is not None and page_id != first
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = packer.compress(record("revisit" if again else "response", page_id, url, digest, payload, first if again else None)) + packer.flush()
                    lines.append(f"{digest} {DATE} " + json.dumps({"offset": at, "length": len(raw), "filename": "data.warc.gz"}))
                    at, count, payload_bytes = at + len(raw), count + 1, payload_bytes + len(payload)
                    yield raw
                    head = next(queue, None)

            name = f"part-{task.partitionId():06d}-{number:05d}.wacz"
            temporary = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(temporary) as out:
                writer = Writer(out, zip64)
                writer.member(ARCHIVE, parts())
                writer.member(INDEX, (f"{line}\n".encode() for line in lines))
                writer.close()
            store.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"package": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})
            number += 1

    ordered = rows.select("page_id", "url", "html", "digest", "first")
    manifest = scratch(rows.sparkSession, "warc-manifest")
    ordered.mapInArrow(write, "package string, records bigint").write.parquet(manifest)
    return rows.sparkSession.read.schema("package string, records bigint").parquet(manifest)


READ = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload binary"


def read_packages(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all packages. The digest of every stored payload is computed anew and must equal its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload", "payload_bytes"]
        held, size = [], 0
        for batch in batches:
            for package in batch.column("package").to_pylist():
                store, path = opened(package)
                with store.open_input_file(path) as file:
                    for r in records(file):
                        if (payload := r["payload"]) is not None and hashlib.sha256(payload).hexdigest() != r["payload_digest"]:
                            raise ValueError(f"payload of page {r['page_id']} in {package} is damaged")
                        r["payload_bytes"] = None if payload is None else len(payload)
                        size += len(payload or b"") + 200
                        held.append(r if with_payload else r | {"payload": None})
                        if size >= 4 << 20 or len(held) >= 5000:
                            yield batch_of(held, names)
                            held, size = [], 0
        if held:
            yield batch_of(held, names)

    def batch_of(rows: list[dict], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return manifest.select("package").mapInArrow(read, f"{READ}, payload_bytes bigint")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as packages, read them: one row per page row.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Of equal payloads of at least 100 bytes the rows
    with the smallest id are responses and the others revisit it; shorter ones are all responses, as are rows without an
    id. Null html is the empty payload. Other columns are not read. A revisit's length comes from the record it refers to; one
    whose record is not there is an error. The packages are read once, their records without payloads kept as a table.
    """
    read = read_packages(write_packages(planned(pages), scratch(spark, "warc")), with_payload=False)
    found = cut(read.drop("payload", "url"), "warc-records")
    own = found.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = found.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    # Rows that repeat the smallest id are all responses with one payload.
    target = own.select(F.col("page_id").alias("t"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).groupBy("t", "d").agg(F.max("n").alias("payload_bytes"))
    missing = F.raise_error(F.concat(F.lit("no record for the revisit of page "), F.col("page_id").cast("string"))).cast("bigint")
    resolved = revisits.join(target, (F.col("refers_to") == F.col("t")) & (F.col("payload_digest") == F.col("d")), "left").withColumn(
        "payload_bytes", F.coalesce("payload_bytes", missing)
    )
    return own.unionByName(resolved.select(own.columns))
