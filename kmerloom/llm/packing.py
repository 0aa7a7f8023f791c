"""Bounded-space online packing of token sequences: a fixed number of open windows a partition, best fit, leftovers merged."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import durable, slices

#: Characters on which both tokenizer libraries agree about letters, digits and white space.
SHARED = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")


@lru_cache(2)
def encoder(json_path: str, ranks_path: str) -> Callable[[str], list[int]]:
    """Ids of the ``tokenizers`` file, add_special_tokens=False. Texts of Latin characters without special-token strings go through
    the same vocabulary's rank file (same ids, some five times the speed), all others through the file itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own: list[Tokenizer] = []  # read when the first text needs it
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SHARED.fullmatch(text) and "<|" not in text:
            return fast.encode_ordinary(text)
        if not own:
            own.append(Tokenizer.from_file(json_path))
        return own[0].encode(text, add_special_tokens=False).ids

    return encode


class Packer:
    """``width`` open windows of ``size`` tokens. A piece goes to the window it leaves the least room in; when it fits none, the
    fullest window closes and a new one opens. ``done`` gets (window number, pieces) of closed windows."""

    def __init__(self, size: int, width: int, done: Callable[[int, list], None]):
        self.size, self.width, self.done = size, width, done
        self.open: list[tuple[int, int]] = []  # (room, number), by room
        self.held: dict[int, list] = {}
        self.opened = 0

    def put(self, length: int, piece) -> None:
        if length == self.size:
            self.done(self._new(), [(0, piece)])
            return
        i = bisect_left(self.open, (length, -1))
        if i == len(self.open):
            if len(self.open) == self.width:
                _, number = self.open.pop(0)
                self.done(number, self.held.pop(number))
            room, number = self.size, self._new()
            self.held[number] = []
        else:
            room, number = self.open.pop(i)
        self.held[number].append((self.size - room, piece))
        if room == length:
            self.done(number, self.held.pop(number))
        else:
            insort(self.open, (room - length, number))

    def _new(self) -> int:
        self.opened += 1
        return self.opened - 1


FIELDS = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("part", "long"), ("window", "long"), ("offset", "long"), ("room", "long"), ("ids", "array<int>")]
KINDS = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
#: Pieces, and ids of pieces, written at a time.
AT_ONCE, IDS_AT_ONCE = 20_000, 1 << 19


def _lists(ids: tuple[np.ndarray | None, ...]) -> pa.Array:
    """The pieces' ids as an Arrow list column, without a Python number for each."""
    if ids[0] is None:
        return pa.nulls(len(ids), KINDS["array<int>"])
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))


def _pack(batches: Iterator[pa.RecordBatch], encode: tuple[str, str], size: int, width: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    part, ready, waiting = TaskContext.get().partitionId(), [], 0

    def close(number: int, pieces: list, room: int = 0) -> None:
        nonlocal waiting
        ready.extend((*p[:5], part, number, offset, room, p[5]) for offset, p in pieces)
        waiting += (size - room) * with_ids

    def flush() -> pa.RecordBatch:
        nonlocal waiting
        out = pa.RecordBatch.from_arrays([_lists(c) if n == "ids" else pa.array(c, KINDS[k]) for c, (n, k) in zip(zip(*ready), FIELDS)], names=[n for n, _ in FIELDS])
        ready.clear()
        waiting = 0
        return out

    packer, ids_of = Packer(size, width, close), encoder(*encode)
    for batch in chain.from_iterable(map(slices, batches)):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.array([*ids_of(text or ""), end_id], "<u4")
            for at in range(0, len(ids), size):
                cut = ids[at : at + size]
                packer.put(len(cut), (doc_id, at, len(cut), zlib.crc32(cut.tobytes()), len(ids), cut.copy() if with_ids else None))
                if len(ready) >= AT_ONCE or waiting >= IDS_AT_ONCE:
                    yield flush()
    for room, number in packer.open:
        close(number, packer.held[number], room)
    if ready:
        yield flush()


def pack(docs: DataFrame, tokenizer: tuple[str, str], size: int = 2048, width: int = 128, end_id: int = 1, fan_in: int = 64, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row a piece of a document's ids and ``end_id``.

    A document longer than ``size`` gives full sequences of its own and a rest; rests are packed online within their
    partition (memory: ``width`` open windows). Windows still open at a partition's end go, as lengths, to a merge of ``fan_in``
    partitions a task: best fit by falling length. ``sequence_id`` is partition * 2^32 + window, or 2^62 + group * 2^31 + place after
    merging: unique, not gapless. Null texts are empty (the end id alone); null and repeated ids keep their rows; an empty table
    gives none. Only a piece's numbers are written between the steps (and its ids where asked for).
    """
    schema = ", ".join(f"{n} {k}" for n, k in FIELDS)
    pieces = durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _pack(b, tokenizer, size, width, end_id, with_ids), schema))
    left = pieces.filter("room > 0").groupBy("part", "window").agg(F.first("room").alias("room")).withColumn("group", F.floor(F.col("part") / fan_in))

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["room"], r["part"], r["window"]))
        out: list[tuple] = []

        def close(number: int, held: list) -> None:
            out.extend((r["part"], r["window"], (1 << 62) + (r["group"] << 31) + number, base) for base, r in held)

        packer = Packer(size, len(rows) + 1, close)
        for r in rows:
            packer.put(size - r["room"], r)
        for _, number in packer.open:
            close(number, packer.held[number])
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=["part", "window", "merged", "base"])

    merged = left.groupBy("group").applyInArrow(merge, "part long, window long, merged long, base long")
    whole = pieces.filter("room = 0").withColumns({"sequence_id": F.col("part") * (1 << 32) + F.col("window"), "at": F.col("offset")})
    rest = pieces.filter("room > 0").join(merged, ["part", "window"]).withColumns({"sequence_id": F.col("merged"), "at": F.col("base") + F.col("offset")})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "at", *["ids"] * with_ids]
    return whole.select(*names).unionByName(rest.select(*names)).withColumnRenamed("at", "offset")
