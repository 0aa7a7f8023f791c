"""Records of standard input, or of any file that grows, as a stream that can be stopped and started again.

A task of Spark has no standard input, so the calling program spools its own to a file (``spool``); the stream's offsets are bytes of that file at
the beginning of a record. A batch that has to be made again is read from the same bytes, so nothing is lost and nothing comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from kmerloom.sources.ranges import CHUNK, SCHEMA, Plain, Record, Stream, records, split_lines

#: A spooled input that has ended has a file of this suffix beside it.
ENDED = ".ended"


class _Ahead:
    """What has been read of an input, put back before it."""

    def __init__(self, head: bytes, rest: BinaryIO) -> None:
        self.head, self.rest = head, rest

    def read(self, n: int) -> bytes:
        out, self.head = self.head, b""
        return out or self.rest.read(n)


def spool(source: BinaryIO, path: str) -> None:
    """Appends an input, plain or gzip, to the file ``path`` until it ends, and marks its end. Every chunk can be read as soon as it has come."""
    head = source.read(2)
    ahead = _Ahead(head, source)
    parts = (text for _, text in Stream(ahead).parts(0)) if head == b"\x1f\x8b" else iter(lambda: ahead.read(CHUNK), b"")
    with open(path, "ab") as out:
        for text in parts:
            out.write(text)
            out.flush()
    Path(path + ENDED).touch()


def whole_records(path: str, start: int, rows: int) -> tuple[list[Record], int]:
    """Up to ``rows`` records from byte ``start`` on, and the byte behind them. The last record of a file that may still grow isn't known to be whole, so it waits."""
    ended = Path(path + ENDED).exists()  # asked first: what comes after this is read next time
    if not Path(path).exists():
        return [], start
    with open(path, "rb") as file:
        found = list(islice(records(split_lines(Plain(file).parts(start))), rows + 1))
        size = file.seek(0, 2)
    if len(found) > rows:
        return found[:rows], found[rows][0]
    if ended:
        return found, size
    return found[:-1], found[-1][0] if found else start


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def _rows(self, found: list[Record]) -> Iterator[tuple]:
        return iter([(self.path, *r) for r in found])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found, end = whole_records(self.path, start["byte"], self.rows)
        return self._rows(found), {"byte": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            lines = split_lines(Plain(file).parts(start["byte"]))
            return self._rows(list(records(x for x in lines if x[0] < end["byte"])))

    def commit(self, end: dict) -> None:
        """Nothing: the spooled file stays, so that a stream begun anew may read it all."""


class TailSource(DataSource):
    """Format ``fastx_tail``: options ``path`` and ``rows`` (records a batch)."""

    @classmethod
    def name(cls) -> str:
        return "fastx_tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("rows", 10_000)))


def stream_tail(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """(path, pos, name, comment, seq, qual) of the records of a file that grows, such as a spooled standard input; the file is read where the driver runs, up to ``rows`` records a batch."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("fastx_tail").option("path", path).option("rows", str(rows)).load()
