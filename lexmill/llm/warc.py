"""WARC files in which every record is a gzip member of its own, with an offset index.

A monolithic .warc.gz is one gzip stream over the whole file: to reach a record all
before it must be inflated. The normaliser inflates the stream once, in chunks, splits it
at the record headers' lengths, deflates every record as its own member and notes
(offset, length) of each, so that any record can be read alone from then on.

Plan: narrow. Files are the unit of parallel work; a task streams its file, so memory is
bounded by the largest record. Output files have names that depend on the input alone
and are put in place by a rename, so a repeated or speculative task does no harm.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, shared_subfolder, table

CHUNK = 1 << 20
LEVEL = 6
#: Bytes of records after which a task begins another monolithic file.
FILE_BYTES = 64 << 20
INDEX = "file string, record long, record_id string, type string, uri string, offset long, length long, size long, digest string"
_INDEX_SCHEMA = pa.schema([("file", pa.string()), ("record", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])


class WarcError(ValueError):
    """The stream is not gzip, is cut off, or holds no well-formed record where one must begin."""


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Bytes of a gzip stream of one or more members, chunk by chunk."""
    engine, began = zlib.decompressobj(31), False
    try:
        for chunk in chunks:
            while chunk:
                if engine.eof:
                    engine = zlib.decompressobj(31)
                began = True
                data = engine.decompress(chunk, 4 * CHUNK)
                if data:
                    yield data
                chunk = engine.unused_data if engine.eof else engine.unconsumed_tail
    except zlib.error as error:
        raise WarcError(f"not a gzip stream: {error}") from error
    if began and not engine.eof:
        raise WarcError("the gzip stream is cut off")


class _Source:
    """Buffered reader over chunks."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held = iter(chunks), bytearray()

    def _more(self) -> bool:
        more = next(self.chunks, None)
        if more is None:
            return False
        self.held += more
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the stream."""
        at = 0
        while (found := self.held.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.held)
            if not self._more():
                if self.held.strip():
                    raise WarcError("a record header is cut off")
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise WarcError("a record is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip_blank(self) -> None:
        while True:
            gone = 0
            while gone < len(self.held) and self.held[gone] in b"\r\n":
                gone += 1
            del self.held[:gone]
            if self.held or not self._more():
                return


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, whole record with its closing blank lines) of an inflated stream."""
    source = _Source(chunks)
    while True:
        source.skip_blank()
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise WarcError(f"no record begins with {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as error:
            raise WarcError("a record has no content length") from error
        yield headers, head + source.take(length) + b"\r\n\r\n"


def member(record: bytes, level: int = LEVEL) -> bytes:
    """The record as one gzip member; the same bytes for the same record."""
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(record) + engine.flush()


def normalise(chunks: Iterable[bytes], sink, level: int = LEVEL) -> Iterator[tuple]:
    """Write a monolithic gzip stream to ``sink`` record by record and yield the index rows without file name:
    (record, record_id, type, uri, offset, length, size, digest)."""
    offset = 0
    for n, (headers, record) in enumerate(records(inflate(chunks))):
        packed = member(record, level)
        sink.write(packed)
        yield n, headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), offset, len(packed), len(record), hashlib.sha1(record).hexdigest()
        offset += len(packed)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path) if not path.startswith("file:") else "file://" + path[5:])


class _Placed:
    """An output file that appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.system, self.path = _system(path)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.part"
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.system.open_output_stream(self.draft)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def place(self) -> None:
        self.out.close()
        self.system.move(self.draft, self.path)

    def drop(self) -> None:
        self.out.close()
        self.system.delete_file(self.draft)


def _write_normalised(name: str, chunks: Iterable[bytes], folder: str, level: int) -> pa.RecordBatch:
    """One output file and its sidecar; its index rows."""
    sink = _Placed(f"{folder}/{name}.warc.gz")
    try:
        rows = [(f"{name}.warc.gz", *row) for row in normalise(chunks, sink, level)]
    except BaseException:
        sink.drop()
        raise
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_INDEX_SCHEMA), _INDEX_SCHEMA)], schema=_INDEX_SCHEMA)
    sidecar = _Placed(f"{folder}/{name}.index.tsv")
    for row in rows:
        sidecar.write(("\t".join("" if x is None else str(x).replace("\t", " ").replace("\n", " ") for x in row[1:]) + "\n").encode())
    sink.place()
    sidecar.place()
    return batch


def _read(path: str) -> Iterator[bytes]:
    system, inner = _system(path)
    with system.open_input_stream(inner, compression=None) as file:
        while data := file.read(CHUNK):
            yield data


def normalise_files(spark: SparkSession, paths: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Normalise every monolithic file named in ``paths`` (column path) into ``folder``; the index of all records.

    The output of a file has the file's name and a digest of its whole path. A null path is ignored, a path
    that is named twice is one file, an empty file has no record, and one that is not gzip, is cut off or
    holds something else than records raises WarcError. The index is written in ``folder`` as Parquet too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                stem = os.path.basename(path).removesuffix(".gz").removesuffix(".warc")
                yield _write_normalised(f"{stem}-{hashlib.sha1(path.encode()).hexdigest()[:12]}", _read(path), folder, level)

    index = paths.filter("path is not null").select("path").distinct().transform(map_batches, run, INDEX)
    index.write.mode("overwrite").parquet(f"{folder}/index.parquet")
    return spark.read.schema(INDEX).parquet(f"{folder}/index.parquet")


def read_record(folder: str, file: str, offset: int, length: int) -> bytes:
    """One record, read and inflated alone."""
    system, inner = _system(f"{folder}/{file}")
    with system.open_input_file(inner) as f:
        return zlib.decompress(f.read_at(length, offset), 31)


def page_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a WARC record of type resource."""
    body = (html or "").encode()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {' '.join((url or '').split())}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _pages(folder: str, level: int, file_bytes: int):
    def monolithic(rows: Iterator[tuple], state: dict) -> Iterator[bytes]:
        """One gzip stream over the records of the next rows, up to ``file_bytes``."""
        engine, size = zlib.compressobj(1, zlib.DEFLATED, 31), 0
        for row in rows:
            record = page_record(*row)
            size += len(record)
            if data := engine.compress(record):
                yield data
            if size >= file_bytes:
                break
        else:
            state["done"] = True
        yield engine.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))))
        task, n, state = TaskContext.get().partitionId(), 0, {"done": False}
        while not state["done"]:
            first = next(rows, None)
            if first is None:
                return
            chained = (r for part in ((first,), rows) for r in part)
            yield _write_normalised(f"pages-{task:06d}-{n:04d}", monolithic(chained, state), folder, level)
            n += 1

    return run


def normalise_pages(pages: DataFrame, folder: str, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages as monolithic WARC streams, each normalised as it is made: the index of all records.

    The streams go straight from the writer to the normaliser, in chunks. The files and their
    sidecars are in ``folder``, and the index there is written once, so reading it runs nothing again.

    * Every row makes a record: null ids, urls and texts are written as empty. Repeated rows make a record each.
    * Other columns are ignored, whatever their names. An empty table makes no file and an empty index.
    """
    spark = pages.sparkSession
    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    typed.transform(map_batches, _pages(folder, level, file_bytes), INDEX).write.mode("overwrite").parquet(f"{folder}/index.parquet")
    return spark.read.schema(INDEX).parquet(f"{folder}/index.parquet")


def op7_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset index of all pages' records, with page_id; the files are in the shared folder."""
    index = normalise_pages(table(spark, sf_dir, "pages"), shared_subfolder(spark, "warc"))
    return index.withColumn("page_id", F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long"))
