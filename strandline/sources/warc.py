"""Web archives: full scans, scans by offset, and a writer with rotation.

Tasks get paths, not contents, and stream them through pyarrow's file systems: a scan holds one piece of a file and one record,
a seek reads the bytes of its record only. Paths on file systems that pyarrow doesn't know fail with its message.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "warc string, record_id string, type string, uri string, day string, payload binary, offset long, gzlen long, error string"
_NAMES = ["warc", "record_id", "type", "uri", "day", "payload", "offset", "gzlen", "error"]
INDEX = "warc string, record_id string, offset long, gzlen long"
PIECE = 1 << 15
#: Records of one gzip member that are held until its length is known; a member with more can't be read by record anyway.
HELD = 1000
RANGE_BYTES = 64 << 20
# When a new file begins.
MAX_BYTES, MAX_RECORDS = 256_000_000, 5000

Found = tuple[dict[str, str], bytes, int, int | None]


def opened(path: str, write: bool = False) -> BinaryIO:
    files, inner = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if path.startswith("file:") else path if "://" in path else f"file://{path}")
    return files.open_output_stream(inner) if write else files.open_input_file(inner)


class Inflated:
    """Reads the content of gzip members one after the other. ``member`` is the offset of the one that the next byte is from."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.seen, self.rest, self.left, self.member, self.unzip = raw, 0, b"", b"", 0, None
        self.ended: list[tuple[int, int]] = []  # offset and length of members that were read to their end

    def fill(self) -> bool:
        """More content; False at the end of the file. Content of two members is never held together."""
        while not self.left:
            if self.unzip is None or self.unzip.eof:
                if not self.rest and not self._more():
                    return False
                self.member, self.unzip = self.seen - len(self.rest), zlib.decompressobj(31)
            if not self.rest and not self._more():
                raise EOFError("truncated gzip member")
            self.left = self.unzip.decompress(self.rest)
            self.rest = self.unzip.unused_data if self.unzip.eof else b""
            if self.unzip.eof:
                self.ended.append((self.member, self.seen - len(self.rest) - self.member))
        return True

    def _more(self) -> bool:
        self.rest = bytes(self.raw.read(PIECE))
        self.seen += len(self.rest)
        return bool(self.rest)

    def readline(self) -> bytes:
        out = []
        while self.fill():
            end = self.left.find(b"\n") + 1
            out.append(self.left[:end] if end else self.left)
            self.left = self.left[end:] if end else b""
            if end:
                break
        return b"".join(out)

    def read(self, n: int) -> bytes:
        out = []
        while n and self.fill():
            out.append(self.left[:n])
            self.left, n = self.left[n:], n - len(out[-1])
        if n:
            raise EOFError("truncated record")
        return b"".join(out)


def _headers(stream) -> dict[str, str] | None:
    """Headers of the next record with lower-case names; None at the end."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        return headers
    return None


def records(handle: BinaryIO) -> Iterator[Found]:
    """(headers, block, offset, length) of the records of a file. The offset is that of the gzip member, the length the member's
    (None if it holds more than HELD records); for files that aren't compressed those of the record."""
    head = bytes(handle.read(2))
    handle.seek(0)
    if head != b"\x1f\x8b":
        plain = handle if isinstance(handle, io.BytesIO) else io.BufferedReader(handle, PIECE)
        while True:
            at = plain.tell()
            while (peek := bytes(plain.read(1))) in (b"\r", b"\n"):
                at += 1
            if not peek:
                return
            plain.seek(at)
            headers = _headers(plain)
            size = int(headers.get("content-length", 0))
            block = bytes(plain.read(size))
            if len(block) < size:
                raise EOFError("truncated record")
            yield headers, block, at, plain.tell() - at
    stream, held = Inflated(handle), []

    def done() -> Iterator[Found]:
        sizes = dict(stream.ended)
        stream.ended.clear()
        yield from ((h, b, at, sizes.get(at)) for h, b, at in held if at in sizes)
        held[:] = [x for x in held if x[2] not in sizes]

    try:
        while stream.fill():
            if not stream.left.strip() and b"\n" in stream.left:
                stream.left = b""  # blank lines between records
                continue
            at = stream.member
            if (headers := _headers(stream)) is None:
                break
            held.append((headers, stream.read(int(headers.get("content-length", 0))), at))
            if not stream.left:
                stream.fill()
            yield from done()
            if len(held) > HELD:
                yield from ((h, b, a, None) for h, b, a in held)
                held.clear()
    finally:
        yield from done()
    yield from ((h, b, at, None) for h, b, at in held)


def _body(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a response: what follows the HTTP header."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("warc-type") in ("response", "revisit") and block[:5] == b"HTTP/" else block


def _row(path: str, found: Found) -> tuple:
    headers, block, offset, size = found
    return path, headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-date"), _body(headers, block), offset, size, None


def _failed(path: str, e: Exception, record_id: str | None = None, offset: int | None = None) -> tuple:
    return path, record_id, None, None, None, None, offset, None, f"{type(e).__name__}: {e}"


def _frames(rows: Iterator[tuple], most: int = 200, size: int = 8 << 20) -> Iterator[pd.DataFrame]:
    held, payload = [], 0
    for row in rows:
        held.append(row)
        payload += len(row[5] or b"")
        if len(held) >= most or payload >= size:
            yield pd.DataFrame(held, columns=_NAMES)
            held, payload = [], 0
    if held:
        yield pd.DataFrame(held, columns=_NAMES)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with opened(path) as handle:
                        yield from (_row(path, x) for x in records(handle))
                except Exception as e:  # a broken file is a finding, not a failure
                    yield _failed(path, e)

    yield from _frames(rows())


def listed(spark: SparkSession, glob: str) -> DataFrame:
    """path, length of archive files; contents aren't read."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime")


def scan(spark: SparkSession, glob: str) -> DataFrame:
    """Every record of the files; a file that breaks off gives its records up to there and a row with error."""
    files = listed(spark, glob)
    n = files.count()
    return files.select("path").repartition(max(1, n), "path").mapInPandas(_scan, RECORD)


def offset_index(scanned: DataFrame) -> DataFrame:
    return scanned.where("error is null and gzlen is not null").select("warc", "record_id", "offset", "gzlen")


def health(scanned: DataFrame) -> DataFrame:
    """warc, ok, error, records: one row per file."""
    return scanned.groupBy("warc").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("records")).withColumn("ok", F.col("error").isNull())


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        path, handle = None, None
        for batch in batches:
            for warc, record_id, offset, size in zip(batch["warc"], batch["record_id"], batch["offset"], batch["gzlen"]):
                try:
                    if warc != path:
                        path, handle = None, opened(warc)
                        path = warc
                    handle.seek(int(offset))
                    part = bytes(handle.read(int(size)))
                    found = [(h, b, int(offset), int(size)) for h, b, _, _ in records(io.BytesIO(part)) if h.get("warc-record-id") == record_id]
                    yield _row(warc, found[0]) if found else _failed(warc, LookupError("not at this place"), record_id, int(offset))
                except Exception as e:
                    yield _failed(warc, e, record_id, int(offset))

    yield from _frames(rows())


def seek(spark: SparkSession, wanted: DataFrame, glob: str | None = None) -> DataFrame:
    """Records at given places: ``wanted`` has warc (a path), record_id, offset, gzlen. Only those bytes are read, in the order
    of offsets, by tasks that have a range of ``RANGE_BYTES`` of a file or several. A record that isn't at its place gives a row
    with error. Rows without a place are found by a scan of ``glob``."""
    placed = wanted.where("offset is not null and gzlen is not null").select("warc", "record_id", F.col("offset").cast("long").alias("offset"), F.col("gzlen").cast("long").alias("gzlen"))
    found = placed.repartition("warc", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("warc", "offset").mapInPandas(_read, RECORD)
    if glob is None:
        return found
    lost = wanted.where("offset is null or gzlen is null").select(F.col("warc").alias("w"), F.col("record_id").alias("r")).distinct()
    if lost.isEmpty():
        return found
    met = scan(spark, glob).join(lost, (F.col("warc") == F.col("w")) & (F.col("record_id") == F.col("r")), "left_semi")
    return found.unionByName(met)


def encoded(record_id: str, kind: str, uri: str | None, day: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """A record as bytes. A revisit names the record that has its payload and has none itself."""
    lines = [("WARC-Type", "revisit" if refers_to else kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Date", day)]
    body = payload
    if refers_to:
        lines += [("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        body = b""
    elif kind == "response" and payload[:5] != b"HTTP/":
        body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + f"Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _writer(path: str, max_bytes: int, max_records: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, out, file, number, size, count, index = TaskContext.get(), None, "", 0, 0, 0, []
        files, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        files.create_dir(inner, recursive=True)

        def close() -> None:
            out.close()
            files.move(f"{inner}/.{file}.{task.taskAttemptId()}", f"{inner}/{file}")

        for batch in batches:
            for record_id, kind, uri, day, payload, refers_to in zip(*(batch[c] for c in ("record_id", "type", "uri", "day", "payload", "refers_to"))):
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(encoded(record_id, kind or "response", uri, day, bytes(payload or b""), refers_to or None)) + pack.flush()
                if out is not None and (size + len(data) > max_bytes or count >= max_records):
                    close()
                    out = None
                if out is None:
                    file, number, size, count = f"part-{task.partitionId():05d}-{number:05d}.warc.gz", number + 1, 0, 0
                    out = files.open_output_stream(f"{inner}/.{file}.{task.taskAttemptId()}", compression=None)
                out.write(data)
                index.append((f"{path}/{file}", record_id, size, len(data)))
                size, count = size + len(data), count + 1
        if out is not None:
            close()
        yield pd.DataFrame(index, columns=["warc", "record_id", "offset", "gzlen"])

    return work


def write(rows: DataFrame, path: str, max_bytes: int = MAX_BYTES, max_records: int = MAX_RECORDS) -> DataFrame:
    """Archives of rows with record_id, type, uri, day, payload and, if there is one, refers_to: a gzip member a record, a new
    file after so many bytes or records. A file appears under its name when it is complete, so a task that runs again replaces
    its own files. Returns the offset index, which is kept below ``path`` as well."""
    own = rows if "refers_to" in rows.columns else rows.withColumn("refers_to", F.lit(None).cast("string"))
    made = own.select("record_id", "type", "uri", "day", "payload", "refers_to").mapInPandas(_writer(path, max_bytes, max_records), INDEX)
    made.write.mode("overwrite").parquet(f"{path}/_index")
    return rows.sparkSession.read.parquet(f"{path}/_index")


def reencode(spark: SparkSession, glob: str, path: str) -> DataFrame:
    """The readable records of archives, a gzip member each."""
    return write(scan(spark, glob).where("error is null"), path)


def rebuild(spark: SparkSession, index: DataFrame, broken: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """A slice written again without rows that refer to broken files: (its offset index, counts by state).

    ``index``: record_id, warc, and store_record, store_warc of the record that has the payload; ``broken``: warc. Rows without
    a reference are taken from their own archive, kept ones from the store; invalid and skipped ones are left out.
    """
    from strandline.operators.quality import classify_refs

    marked = classify_refs(index, "store_record", "store_warc", broken)
    counts = marked.groupBy("state").agg(F.count("*").alias("n"))
    good = marked.where("state in ('kept', 'passthrough')")
    places = good.select(F.coalesce("store_warc", "warc").alias("warc"), F.coalesce("store_record", "record_id").alias("record_id")).distinct()
    files = places.select("warc").distinct()
    found = files.select(F.col("warc").alias("path")).repartition("path").mapInPandas(_scan, RECORD).where("error is null").join(places, ["warc", "record_id"], "left_semi")
    named = good.select(F.col("record_id").alias("own"), F.coalesce("store_record", "record_id").alias("record_id"))
    rows = found.join(named, "record_id").drop("record_id").withColumnRenamed("own", "record_id")
    return write(rows, path), counts


def scrub(index: DataFrame, field: str, broken: DataFrame) -> DataFrame:
    """``index`` without rows whose ``field`` names a broken file."""
    return index.join(broken.select(F.col("warc").alias("__b")).distinct(), F.col(field) == F.col("__b"), "left_anti")


def scrub_lines(lines: DataFrame, broken: DataFrame, most: int = 10_000) -> DataFrame:
    """Lines of a raw index that name no broken file anywhere in them, as the store's index is scrubbed; at most ``most`` files."""
    names = [r[0] for r in broken.select("warc").where("warc is not null").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"at most {most} broken files")
    return lines.where(~F.exists(F.array(*(F.lit(n) for n in names)).cast("array<string>"), lambda n: F.contains("value", n))) if names else lines


def replaced(slices: DataFrame, rebuilt: DataFrame, key: str = "warc") -> DataFrame:
    """The rows of ``rebuilt``, and of ``slices`` those under keys that weren't rebuilt."""
    return slices.join(rebuilt.select(key).distinct(), key, "left_anti").unionByName(rebuilt)
