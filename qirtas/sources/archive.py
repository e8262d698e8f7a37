"""Members of ZIP archives as a table: a Python data source that reads ranges, not archives.

An archive is a path all executors can read, or an address (http, https) of a server that answers range requests.
"""

from __future__ import annotations

import os
import struct
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, size bigint, content binary"
#: A range is asked for so often; waits double from one second on.
TRIES = 5


class Ranges:
    """Reads stretches of a file, wherever it is.  Server errors and broken connections are tried again, other errors pass through."""

    def __init__(self, path: str, sleep=time.sleep):
        self.path, self.sleep = path, sleep
        self.remote = path.startswith(("http://", "https://"))
        self.file = None if self.remote else open(path, "rb")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.file:
            self.file.close()

    def _ask(self, headers: dict[str, str], method: str = "GET"):
        for n in range(TRIES):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.path, headers=headers, method=method), timeout=60) as answer:
                    return answer.status, answer.headers, answer.read()
            except urllib.error.HTTPError as e:
                if e.code < 500 or n == TRIES - 1:
                    raise
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                if n == TRIES - 1:
                    raise
            self.sleep(2.0**n)
        raise RuntimeError("tried in vain")

    def length(self) -> int:
        return int(self._ask({}, "HEAD")[1]["Content-Length"]) if self.remote else os.fstat(self.file.fileno()).st_size

    def read(self, start: int, n: int) -> bytes:
        if n <= 0:
            return b""
        if not self.remote:
            self.file.seek(start)
            return self.file.read(n)
        status, _, data = self._ask({"Range": f"bytes={start}-{start + n - 1}"})
        if status != 206:
            raise ValueError(f"{self.path}: the server does not answer range requests")
        return data


def _end(source: Ranges) -> tuple[int, int, int]:
    """(members, bytes, start) of the central directory; of large archives, from the wider record."""
    length = source.length()
    back = min(length, 65_557)
    tail = source.read(length - back, back)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError(f"{source.path} is no ZIP archive")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        place = tail.rfind(b"PK\x06\x07", 0, at)
        if place >= 0:
            (wide,) = struct.unpack("<Q", tail[place + 8 : place + 16])
            count, size, start = struct.unpack("<QQQ", source.read(wide, 56)[32:56])
    return count, size, start


def directory(path: str) -> list[tuple[str, int, int, int, int, int]]:
    """(name, method, crc, packed size, size, offset) of the members, from the central directory alone."""
    with Ranges(path) as source:
        count, size, start = _end(source)
        data = source.read(start, size)
    out, pos = [], 0
    for _ in range(count):
        method, crc, packed, whole, n, extra, comment, offset = struct.unpack("<10xH4xIIIHHH8xI", data[pos : pos + 46])
        wide = _wide_fields(data[pos + 46 + n : pos + 46 + n + extra])
        whole, packed, offset = (next(wide, x) if x == 0xFFFFFFFF else x for x in (whole, packed, offset))
        out.append((data[pos + 46 : pos + 46 + n].decode("utf-8"), method, crc, packed, whole, offset))
        pos += 46 + n + extra + comment
    return out


def _wide_fields(extra: bytes) -> Iterator[int]:
    """The 64-bit numbers of a member's extra fields, in their order."""
    pos = 0
    while pos + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[pos : pos + 4])
        if kind == 1:
            yield from (x for (x,) in struct.iter_unpack("<Q", extra[pos + 4 : pos + 4 + n - n % 8]))
        pos += 4 + n


def member(source: Ranges, entry: tuple[str, int, int, int, int, int]) -> bytes:
    """One member, stored or deflated, checked against its size and checksum."""
    name, method, crc, packed, whole, offset = entry
    n, extra = struct.unpack("<HH", source.read(offset, 30)[26:30])
    raw = source.read(offset + 30 + n + extra, packed)
    if method not in (0, 8):
        raise ValueError(f"{name}: compression {method} is not read")
    data = zlib.decompress(raw, -15) if method == 8 else raw
    if len(data) != whole or zlib.crc32(data) != crc:
        raise ValueError(f"{name}: its checksum or size is wrong")
    return data


class _Part(InputPartition):
    def __init__(self, entries):
        super().__init__(None)
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.prefix = options.get("prefix", "")
        self.bytes = int(options.get("partitionbytes", 16_000_000))

    def partitions(self) -> list[_Part]:
        parts, now, size = [], [], 0
        for e in sorted(directory(self.path), key=lambda e: e[5]):
            if e[0].endswith("/") or not e[0].startswith(self.prefix):
                continue
            if now and size + e[3] > self.bytes:
                parts.append(_Part(now))
                now, size = [], 0
            now.append(e)
            size += e[3]
        return [*parts, _Part(now)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with Ranges(self.path) as source:
            for e in partition.entries:
                yield e[0], e[4], member(source, e)


class ZipSource(DataSource):
    """format("zip_members"): options path, prefix (of member names), partitionBytes.  A wrong checksum fails."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archive(spark: SparkSession, path: str, prefix: str = ""):
    """(name, size, content) of an archive's members, read in ranges by the executors; the path or address must be theirs too."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("path", path).option("prefix", prefix).load()


def download(address: str, path: str, block: int = 1 << 20) -> int:
    """Copy what an address holds to a file, block by block; the file appears when it is whole.  Returns its length."""
    total, part = 0, f"{path}.part"
    with urllib.request.urlopen(address, timeout=60) as answer, open(part, "wb") as f:
        while data := answer.read(block):
            f.write(data)
            total += len(data)
        wanted = answer.headers.get("Content-Length")
    if wanted is not None and int(wanted) != total:
        os.remove(part)
        raise ValueError(f"{address}: {total} of {wanted} bytes came")
    os.replace(part, path)
    return total
