"""FASTA and FASTQ files of any size as a partitioned source: byte ranges of plain and block-wise gzip files, other gzip files as a stream.

A range answers for the records that begin in it and reads on past its end to finish the last one. Where a record begins can't be told from a line
alone (a quality may begin with ``@``), so the reader goes back from the range's start, follows the records from every possible beginning there,
and takes the place at which all of those whose qualities fit arrive (in a file that begins with ``>``, all); if they differ, or none fits, it goes back
further, at last to the file's start. The true beginnings are among them, so the place is exact, unless a single wrapped record with marks in its quality is longer than the ``BACK`` bytes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, pos long, name string, comment string, seq string, qual string"
#: Bytes read at once, bytes gone back at first (and how many times more at each further try), bytes and rows of a batch.
CHUNK, BACK, FURTHER, BATCH_BYTES, BATCH_ROWS = 1 << 20, 1 << 20, 16, 8 << 20, 10_000
#: Stores that a task reads by itself; files of any other are read whole by Spark.
SCHEMES = {"", "file", "hdfs", "s3", "s3a", "gs"}
#: A block-wise gzip file begins like this: gzip, deflate, extra field; its subfield BC holds the block's size. Fixed values of the format.
BLOCK_MAGIC, BLOCK_FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


class Broken(ValueError):
    """A quality that is longer than its sequence."""


Record = tuple[int, str, str, str, str | None]
Lines = Iterator[tuple[int, bytes]]


def records(lines: Iterable[tuple[int, bytes]]) -> Iterator[Record]:
    """(place, name, comment, sequence, quality) of the records in (place, line). A quality runs until it is as long as its sequence, so it may
    hold any mark; one that the file's end cuts off gives no record."""
    head, begin, letters, quality, need, got = b"", -1, [], None, 0, 0

    def record() -> Record:
        name, *rest = head.split(None, 1) if head[:1].strip() else (b"", head)
        text = (name, rest[0].strip() if rest else b"", b"".join(letters).upper())
        return begin, *(t.decode("utf-8", "replace") for t in text), None if quality is None else b"".join(quality).decode("utf-8", "replace")

    for at, line in lines:
        line = line.rstrip(b"\r\n")
        if quality is not None:
            quality.append(line)
            got += len(line)
            if got > need:
                raise Broken(f"a quality of {got} marks for {need} letters in the record at {begin}")
            if got == need:
                yield record()
                begin, letters, quality = -1, [], None
        elif line[:1] in (b">", b"@"):
            if begin >= 0:
                yield record()
            head, begin, letters = line[1:], at, []
        elif line[:1] == b"+" and begin >= 0:
            need, got, quality = sum(map(len, letters)), 0, []
            if not need:
                yield record()
                begin, letters, quality = -1, [], None
        elif begin >= 0:
            letters.append(b"".join(line.split()))
    if begin >= 0 and quality is None:
        yield record()


def split_lines(parts: Iterable[tuple[int, bytes]]) -> Lines:
    """(place, line) of (place, bytes) stretches; a line's place is its first byte's."""
    held, begin = [], -1
    for base, data in parts:
        i = 0
        while (j := data.find(b"\n", i)) >= 0:
            yield base + i if begin < 0 else begin, b"".join([*held, data[i:j]])
            held, begin, i = [], -1, j + 1
        if i < len(data):
            begin = base + i if begin < 0 else begin
            held.append(data[i:])
    if begin >= 0:
        yield begin, b"".join(held)


def _open(path: str) -> BinaryIO:
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


class Plain:
    """Places are byte offsets."""

    shift = 0

    def __init__(self, file: BinaryIO) -> None:
        self.file = file

    def parts(self, at: int) -> Iterator[tuple[int, bytes]]:
        while True:
            self.file.seek(at)
            data = self.file.read(CHUNK)
            if not data:
                return
            yield at, data
            at += len(data)

    def lines(self, at: int) -> Lines:
        """Lines that begin at byte ``at`` or later."""
        if not at:
            return split_lines(self.parts(0))
        found = split_lines(self.parts(at - 1))
        next(found, None)  # the rest of the line before, or its end alone
        return found


class Blocked(Plain):
    """Block-wise gzip. A place is a block's offset times 65536 plus the place in its text."""

    shift = 16

    def parts(self, at: int) -> Iterator[tuple[int, bytes]]:
        """Texts of the blocks from the first that begins at byte ``at`` or later on. What looks like a block's beginning within another block doesn't inflate."""
        held, base, i, sought = b"", at, 0, not at  # held[i:] is read but not used, and begins at base
        while True:
            self.file.seek(base + len(held) - i)
            data = self.file.read(CHUNK)
            held, i = held[i:] + data, 0
            while True:
                if not sought:
                    found = held.find(BLOCK_MAGIC, i)
                    found = max(i, len(held) - 3) if found < 0 else found
                    base, i = base + found - i, found
                if len(held) < i + 18:
                    break
                size = int.from_bytes(held[i + 16 : i + 18], "little") + 1
                if sought or held[i + 12 : i + 16] == BLOCK_FIELD:
                    if len(held) < i + size:
                        break
                    try:
                        text = zlib.decompress(held[i : i + size], 31)
                    except zlib.error:
                        if sought:
                            raise
                        base, i = base + 1, i + 1
                        continue
                    yield base << 16, text
                    base, i, sought = base + size, i + size, True
                else:
                    base, i = base + 1, i + 1
            if not data:
                return

    def lines(self, at: int) -> Lines:
        found = split_lines(self.parts(at >> 16))
        if at:
            next(found, None)  # its beginning is unknown
        return found


class Stream(Plain):
    """Any other gzip file, inflated as it is read; a place is an offset in its text."""

    def parts(self, at: int) -> Iterator[tuple[int, bytes]]:
        done, inflate = 0, zlib.decompressobj(31)
        while data := self.file.read(CHUNK):
            full = False
            while data or full:
                text = inflate.decompress(data, CHUNK)
                if text:
                    yield done, text
                    done += len(text)
                data, full = inflate.unconsumed_tail, len(text) == CHUNK
                if inflate.eof:  # the next member, if there is one
                    data, inflate, full = inflate.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False


def kind_of(head: bytes) -> str:
    return "plain" if head[:2] != b"\x1f\x8b" else "blocked" if head[:4] == BLOCK_MAGIC and head[12:16] == BLOCK_FIELD else "stream"


KINDS = {"plain": Plain, "blocked": Blocked, "stream": Stream}


def first_record(source: Plain, begin: int) -> int | None:
    """Place of the first record that begins at ``begin`` (a place) or later; None without one."""
    back = BACK
    fasta = next((line[:1] == b">" for _, line in source.lines(0) if line.strip()), False)
    while True:
        start = max(0, (begin >> source.shift) - back) << source.shift
        window = []  # lines before ``begin``, and one behind
        rest = source.lines(start)
        for item in rest:
            window.append(item)
            if item[0] >= begin:
                break
        read: list[tuple[int, bytes]] = []

        def following(i: int) -> Lines:
            """The lines from the window's i-th on; those behind it are read once for all beginnings."""
            yield from (window[k] for k in range(i, len(window)))
            i = 0
            while True:
                if i == len(read):
                    item = next(rest, None)
                    if item is None:
                        return
                    read.append(item)
                yield read[i]
                i += 1

        known: dict[int, tuple[int | None, bool]] = {}
        marks = [i for i, (at, line) in enumerate(window) if at < begin and line[:1] in (b"@", b">")] if start else [0]
        for i in reversed(marks):  # later ones first, so that each is followed to one that is known
            path: list[int] = []
            sure, found = True, None
            try:
                for at, *_, quality in records(following(i)):
                    if at >= begin:
                        found = at
                        break
                    if at in known:
                        found, rest_sure = known[at]
                        sure = sure and rest_sure
                        break
                    path.append(at)
                    sure = sure and (fasta or quality is not None)
            except Broken:
                if not start:
                    raise
                continue
            for at in path:
                known[at] = found, sure
        if not start:
            return found if marks and window else None
        agreed = {found for found, sure in known.values() if sure}
        if len(agreed) == 1:
            return agreed.pop()
        back *= FURTHER


def read_range(source: Plain, begin: int, end: int | None) -> Iterator[Record]:
    """Records that begin in [begin, end), places as the source counts them."""
    first = first_record(source, begin) if begin else 0
    if first is None or end is not None and first >= end:
        return
    lines = (x for x in split_lines(source.parts(first >> source.shift)) if x[0] >= first)
    for record in records(lines):
        if end is not None and record[0] >= end:
            return
        yield record


@dataclass
class Ranges(InputPartition):
    """(path, begin, end) in bytes of the file, several for small files."""

    ranges: tuple[tuple[str, int, int | None], ...]


class FastxReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], split: int) -> None:
        self.files, self.split = files, split

    def partitions(self) -> list[Ranges]:
        """Ranges of ``split`` bytes; a partition holds one, or as many small files as make it up."""
        out, now, size = [], [], 0
        for path, length in self.files:
            for begin in range(0, length, self.split):
                piece = min(self.split, length - begin)
                if now and size + piece > self.split:
                    out.append(Ranges(tuple(now)))
                    now, size = [], 0
                now.append((path, begin, begin + piece if begin + piece < length else None))
                size += piece
        return [*out, Ranges(tuple(now))]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.string()), ("pos", pa.int64()), *((c, pa.string()) for c in ("name", "comment", "seq", "qual"))]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

        for path, begin, end in partition.ranges:
            with _open(path) as file:
                source = KINDS[kind_of(file.read(18))](file)
                file.seek(0)
                if isinstance(source, Stream):  # can't be read from within: its first range reads all
                    if begin:
                        continue
                    end = None
                try:
                    for record in read_range(source, begin << source.shift, None if end is None else end << source.shift):
                        rows.append((path, *record))
                        size += 2 * len(record[3]) + 100
                        if size > BATCH_BYTES or len(rows) == BATCH_ROWS:
                            yield batch()
                            rows, size = [], 0
                except Broken as e:
                    raise Broken(f"{path}: {e}") from None
        if rows:
            yield batch()


class FastxSource(DataSource):
    """Format ``fastx``: options ``files`` (JSON list of path and size) and ``split`` (bytes a partition)."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader([(p, n) for p, n in json.loads(self.options["files"])], int(self.options["split"]))


def list_files(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of files, folders (their files, but hidden ones) and patterns of any store that Spark knows, in order of path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in [paths] if isinstance(paths, str) else paths:
        where = hadoop.Path(path)
        store = where.getFileSystem(conf)
        matched = list(store.globStatus(where) or [])
        if not matched:
            raise FileNotFoundError(path)
        while matched:
            status = matched.pop()
            if status.isDirectory():
                matched += [s for s in store.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
            else:
                found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def scan_fastx(spark: SparkSession, paths: str | list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """(path, pos, name, comment, seq, qual) of FASTA and FASTQ files of any size, plain, block-wise gzip (both in ranges of ``split_bytes``) or gzip (a task a file);
    memory is a few records and ``CHUNK`` bytes a task.

    ``pos`` grows with a record's place in its file. Names may repeat. A quality longer than its sequence is an error that names the file and place; one
    cut off by the file's end gives no record. Files of stores beyond ``SCHEMES`` are read whole by Spark (``pos`` is their record's number then). Empty files give no rows.
    """
    from kmerloom.sources.fastx import read_fastx

    files = list_files(spark, paths)
    if any((p.split(":", 1)[0] if ":" in p.split("/", 1)[0] else "") not in SCHEMES for p, _ in files):
        return read_fastx(spark, [p for p, _ in files]).withColumnRenamed("ord", "pos")
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("files", json.dumps(files)).option("split", str(split_bytes)).load()
