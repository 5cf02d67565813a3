"""WARC records in ZIP packages, written and read by range.

A package is a ZIP archive with two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member per WARC
record, and ``indexes/index.cdxj``, one line per record with its offset and length. The reader takes the end of the
file, finds the central directory through the end record or, for large archives, the ZIP64 records, locates the stored
members from the local headers, and then reads single records by range; nothing is unpacked to disk.

Writing tasks name their archives by partition and attempt and leave rows of a manifest; the manifest, a table inside
the folder, is written as a whole at the end and says which archives count, so that what a failed or repeated task has left
behind is never read.

Of records with equal payloads of at least `min_revisit` bytes, the one with the smallest page_id is a response and the
others revisit it.

Defined results: a null html counts as empty; a null page_id is written as an empty id and read as null, and comes
after all ids; rows that repeat the smallest page_id and payload are responses all; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, new_path, saved

# fixed values of the ZIP format: signatures, and the sizes of its records
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
END_SIZE, COMMENT_MAX = 22, 65535
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "_manifest"
#: A task ends a package at this size, and reads at most so much of an archive at a time.
PACKAGE_BYTES, READ_BYTES = 256 << 20, 8 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, type, refers_to, payload (None in a revisit), payload bytes and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda k: int(v) if (v := fields.get(k, "<urn:page:>")[10:-1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != told or sha1_base32(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that its digest is of")
    return {"page_id": number("WARC-Record-ID"), "type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To") if revisit else None, "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": told, "digest": digest}


class PackageWriter:
    """A ZIP of stored members, written front to back; ZIP64 fields where sizes or places need them."""

    def __init__(self, out, always64: bool = False):
        self.out, self.at, self.members, self.always64 = out, 0, [], always64

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A member whose size is not known yet: it follows in a data descriptor (bit 3)."""
        self.members.append({"name": name.encode(), "at": self.at, "crc": 0, "size": 0})
        self.write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 0x21, 0, FULL32, FULL32, len(name), 20) + name.encode() + struct.pack("<HHQQ", 1, 16, 0, 0))

    def add(self, data: bytes) -> int:
        """Append to the member; where the data begin in it."""
        m = self.members[-1]
        place = m["size"]
        m["crc"], m["size"] = zlib.crc32(data, m["crc"]), place + len(data)
        self.write(data)
        return place

    def end(self) -> None:
        m = self.members[-1]
        self.write(b"PK\x07\x08" + struct.pack("<IQQ", m["crc"], m["size"], m["size"]))

    def close(self) -> None:
        begin = self.at
        for m in self.members:
            large = self.always64 or max(m["size"], m["at"]) >= FULL32
            size, at = (FULL32, FULL32) if large else (m["size"], m["at"])
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["at"]) if large else b""
            self.write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, at) + m["name"] + extra)
        length = self.at - begin
        if self.always64 or max(begin, length) >= FULL32 or len(self.members) >= FULL16:
            there = self.at
            self.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(self.members), len(self.members), length, begin))
            self.write(LOCATOR64 + struct.pack("<IQI", 0, there, 1))
            count, length, begin = FULL16, FULL32, FULL32
        else:
            count = len(self.members)
        self.write(END + struct.pack("<HHHHIIH", 0, 0, count, count, length, begin, 0))


def stored_members(read, size: int) -> dict[str, tuple[int, int]]:
    """name -> (place, length) of the members' data; read(at, n) gives bytes of the archive."""
    tail_at = max(0, size - END_SIZE - COMMENT_MAX)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive, or cut short")
    count, length, begin = struct.unpack_from("<HII", tail, end + 10)
    if FULL16 == count or FULL32 in (length, begin):
        where = tail_at + end - 20
        locator = read(where, 20) if where >= 0 else b""
        if locator[:4] == LOCATOR64:
            there = struct.unpack_from("<Q", locator, 8)[0]
            record = read(there, 56)
            if record[:4] != END64:
                raise ValueError("the ZIP64 locator does not point to a ZIP64 end record")
            count, length, begin = struct.unpack_from("<QQQ", record, 32)
    directory, at, out = read(begin, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n, x, c = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name, extra, here = directory[at + 46 : at + 46 + n].decode(), directory[at + 46 + n : at + 46 + n + x], 0
        while here + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, here)
            if kind == 1:
                values = list(struct.unpack_from(f"<{long // 8}Q", extra, here + 4))
                full = values.pop(0) if full == FULL32 else full
                packed = values.pop(0) if packed == FULL32 else packed
                header = values.pop(0) if header == FULL32 else header
            here += 4 + long
        at += 46 + n + x + c
        if method == 0 and not flags & 1:
            local = read(header, 30)
            if local[:4] != LOCAL:
                raise ValueError(f"no local header for {name}")
            out[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return out


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def write_packages(pages: DataFrame, folder: str, min_revisit: int = 0, always64: bool = False) -> DataFrame:
    """Write all rows of pages(page_id, url, html) as records; a written table (path, records, bytes) of the packages."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    read = read.withColumn("digest", F.unhex(F.sha2("html", 256))).withColumn("size", F.octet_length("html"))
    groups = saved(read.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")), "warc-groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    rows = join_groups(read, groups, "digest", "copies", total)
    rows = rows.select("page_id", "url", "html", "first", (F.col("page_id").eqNullSafe(F.col("first")) | (F.col("size") < min_revisit)).alias("whole"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        made, package, index, path = [], None, [], ""

        def close() -> None:
            package.end()
            package.begin(INDEX)
            package.add("".join(index).encode())
            package.end()
            package.close()
            package.out.close()
            made.append((path, len(index), package.at))

        for batch in batches:
            for page_id, url, html, first, whole in zip(*[batch.column(i) for i in range(5)], strict=True):
                if package is None:
                    path, index = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.wacz", []
                    package = PackageWriter(store.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}"), always64)
                    package.begin(DATA)
                payload = html.as_py().encode()
                raw = warc_record(page_id.as_py(), url.as_py(), payload, first.as_py(), not whole.as_py())
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = squeeze.compress(raw) + squeeze.flush()
                place = package.add(packed)
                index.append(f"{'' if page_id.as_py() is None else page_id.as_py()} {json.dumps({'offset': place, 'length': len(packed)})}\n")
                if package.at >= PACKAGE_BYTES:
                    close()
                    package = None
        if package is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64())], ["path", "records", "bytes"])

    manifest = f"{folder}/{MANIFEST}"
    rows.mapInArrow(write, "path string, records long, bytes long").write.parquet(manifest)
    return find_packages(pages.sparkSession, folder)


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """packages(path, bytes) -> page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in fields.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = open_store(path)
                with store.open_input_file(place) as f:

                    def read(at: int, n: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    members = stored_members(read, size)
                    (data, _), (index, length) = members[DATA], members[INDEX]
                    spots = [json.loads(x.split(b" ", 1)[1]) for x in read(index, length).splitlines()]
                    got, held = [], 0
                    for s in spots:
                        r = parse_record(zlib.decompress(read(data + s["offset"], s["length"]), 31))
                        got.append((r["page_id"], r["url"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"]) + (r["payload"],) * with_payload)
                        held += s["length"]
                        if held >= READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names)
                            got, held = [], 0
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names)

    # a task for each package; packages have a bounded size
    return packages.select("path", "bytes").repartitionByRange(max(1, packages.count()), "path").mapInArrow(scan, fields)


def find_packages(spark: SparkSession, folder: str) -> DataFrame:
    """path, records, bytes of the packages that a finished write_packages left in the folder."""
    return spark.read.schema("path string, records long, bytes long").parquet(f"{folder}/{MANIFEST}")


def list_packages(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes of all packages in a folder without a manifest, listed without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select("path", F.col("length").alias("bytes"))


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder, min_revisit)).drop("url")
