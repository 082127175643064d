"""WARC records in ZIP packages: writing, and reading by range without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, dealt, file_at, fresh_path, output, scan, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records in one package, of records fetched by one read, and of one step of a sequential read.
PACKAGE_BYTES, READ_BYTES, STEP_BYTES = 256 << 20, 4 << 20, 1 << 20
#: Fixed date of all records: the table has none.
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit (HTTP headers only) of the page refers_to."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def parsed(data: bytes) -> dict:
    """What a record says: its page, url, kind, payload (revisit: none), size and digest of the full payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    kind, size = fields["warc-type"], int(_headers(http)["content-length"])
    if kind == "response" and (len(payload) != size or f"sha1:{sha1_base32(payload)}" != fields["warc-payload-digest"]):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its headers")
    page = lambda name: int(fields[name].removeprefix("<urn:page:").rstrip(">")) if fields.get(name, "<urn:page:>") != "<urn:page:>" else None
    return {
        "page_id": page("warc-record-id"),
        "url": fields["warc-target-uri"],
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": page("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


class Package:
    """A ZIP file seen through range reads: its directory, and the place of each stored member."""

    def __init__(self, uri: str):
        files, path = file_at(uri)
        self.file, self.uri = files.open_input_file(path), uri
        self.size = self.file.size()
        self.members = self._directory()

    def read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError(f"{self.uri} ends before byte {start + size}")
        return data

    def _directory(self) -> dict[str, dict]:
        tail_size = min(self.size, 22 + 65535)  # the last record and the longest comment
        tail = self.read(self.size - tail_size, tail_size)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError(f"no ZIP directory in {self.uri}")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        end = self.size - tail_size + at
        if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
            signature, _, where, _ = struct.unpack("<4sIQI", self.read(end - 20, 20))
            if signature != b"PK\x06\x07":
                raise ValueError(f"no ZIP64 locator in {self.uri}")
            zip64 = self.read(where, 56)
            if zip64[:4] != b"PK\x06\x06":
                raise ValueError(f"no ZIP64 directory in {self.uri}")
            count, size, start = struct.unpack_from("<QQQ", zip64, 32)
        directory, members, at = self.read(start, size), {}, 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError(f"broken ZIP directory in {self.uri}")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            offset = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # only the fields that overflowed, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    offset = next(values) if offset == 0xFFFFFFFF else offset
                e += 4 + n
            members[name] = {"method": method, "size": packed, "header": offset}
            at += 46 + n_name + n_extra + n_comment
        return members

    def stored_at(self, name: str) -> tuple[int, int]:
        """First byte and size of a stored member's data."""
        member = self.members[name]
        if member["method"] != 0:
            raise ValueError(f"{name} in {self.uri} is compressed; only stored members can be read by range")
        header = self.read(member["header"], 30)
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        return member["header"] + 30 + n_name + n_extra, member["size"]

    def walk(self, name: str) -> Iterator[tuple[int, int]]:
        """Place of each gzip record of a member that has no index, by reading it in steps."""
        start, size = self.stored_at(name)
        at = begin = 0
        unzip = zlib.decompressobj(31)
        data = b""
        while at < size or data:
            if not data:
                data = self.read(start + at, min(STEP_BYTES, size - at))
                at += len(data)
            unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                end = at - len(data)
                yield begin, end - begin
                begin, unzip = end, zlib.decompressobj(31)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = file_at(folder)
    files.create_dir(root, recursive=True)
    context = TaskContext.get()
    rows = ((p, u, (h or "").encode(), r) for b in batches for p, u, h, r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    row, number = next(rows, None), 0
    while row is not None:
        name = f"part-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.zip"  # an attempt never overwrites another
        index, at = [], 0
        with files.open_output_stream(f"{root}/{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as package:
            with package.open(ARCHIVE, "w", force_zip64=True) as out:
                while row is not None and at < PACKAGE_BYTES:
                    page_id, url, payload, refers_to = row
                    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = zipped.compress(record(page_id, url, payload, refers_to)) + zipped.flush()
                    out.write(data)
                    entry = {"url": url, "offset": str(at), "length": str(len(data)), "filename": ARCHIVE}
                    index.append(f"{'' if page_id is None else page_id} {DATE[:10].replace('-', '')}000000 {json.dumps(entry)}\n")
                    at += len(data)
                    row = next(rows, None)
            with package.open(INDEX, "w", force_zip64=True) as out:
                out.write("".join(index).encode())
        number += 1
        yield output({"path": ([f"{folder}/{name}"], pa.string()), "n_records": ([len(index)], pa.int64())})


def with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id with an equal payload, null if it is the row's own.

    Only digests that occur with more than one page_id are joined back; their rows are dealt over salts, so one very
    common payload does not meet in one task.
    """
    salts = 32
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumns({"_digest": F.when(size >= min_bytes, digest), "_salt": F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")})
    ids = rows.where("_digest is not null").groupBy("_digest").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first"))
    copies = ids.where("_first < _last").select("_digest", "_last", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    joined = rows.join(copies, ["_digest", "_salt"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("_last"), F.col("_last")).alias("refers_to"))


def write_packages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes a WARC record per page into ZIP packages in the shared folder; returns path and n_records of each.

    Of records with equal payloads of at least min_bytes, that with the largest page_id is a response and the others
    revisit it. Null html is an empty payload; a null url becomes about:blank; a row with a null page_id is always a
    response; rows that repeat the largest page_id of a payload are responses all; an empty table gives no package;
    further columns are not read. The list is written before it is used: it names packages of finished attempts only.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    written = arrow_map(with_originals(pages, min_bytes), partial(_write, folder=folder), "path string, n_records long")
    return stored(written, "warc-list")


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            package = Package(path)
            for archive in [m for m in package.members if m.endswith((".warc.gz", ".warc"))]:
                start, _ = package.stored_at(archive)
                places: list[tuple[int, int]] = []
                for index in [m for m in package.members if m.endswith(".cdxj")]:
                    lines = package.read(*package.stored_at(index)).decode().splitlines()
                    entries = (json.loads(line.split(" ", 2)[2]) for line in lines)
                    places += [(int(e["offset"]), int(e["length"])) for e in entries if e["filename"] == archive]
                runs: list[list[tuple[int, int]]] = []
                for place in sorted(places) or package.walk(archive):
                    if not runs or runs[-1][-1][0] + runs[-1][-1][1] != place[0] or place[0] - runs[-1][0][0] >= READ_BYTES:
                        runs.append([])
                    runs[-1].append(place)
                kind = pa.list_(pa.int64())
                yield output({"path": ([path] * len(runs), pa.string()), "start": ([start + r[0][0] for r in runs], pa.int64()), "lengths": ([[n for _, n in r] for r in runs], kind)})


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    for batch in batches:
        for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, at, rows = Package(path).read(start, sum(lengths)), 0, []
            for length in lengths:
                piece = data[at : at + length]
                rows.append(parsed(zlib.decompress(piece, 31) if piece[:2] == b"\x1f\x8b" else piece))
                at += length
            yield output({name: ([r[name] for r in rows], kind) for name, kind in kinds.items()})


def read_packages(listed: DataFrame) -> DataFrame:
    """Every record of the packages at `path`: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Packages are located first (directory, stored archive, index; without an index the archive is walked), then runs of
    neighbouring records are dealt out and fetched by range. A damaged package or payload is an error.
    """
    places = arrow_map(listed.select("path"), _locate, "path string, start long, lengths array<bigint>")
    fields = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return arrow_map(dealt(places, "path", "start"), _fetch, fields)


def op3_warc_zip(spark, sf_dir):
    rows = read_packages(write_packages(scan(spark, sf_dir, "pages", "page_id", "url", "html")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
