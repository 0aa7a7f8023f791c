"""Read-only structures of fixed size that a row can ask about its hashes: counters, exact deep hashes, and a filter of a list.

Each is built by all tasks (a task folds its own part in place and hands on blocks, which are summed by block), has a size that its parameters or a count bound, and
is then broadcast once. A row's list is asked in its own row by an Arrow function, so nothing is shuffled and streams need no state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.cluster import durable
from kmerloom.functions import kmers as K

#: Numbers of a block; deep hashes there may be at most; bits a filter has for each key, and at most in all.
BLOCK, DEEP, BITS, MOST_BITS = 1 << 16, 4_000_000, 12, 1 << 29
_TIMES = np.random.default_rng(7).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def as_numbers(values: np.ndarray) -> np.ndarray:
    """Hashes as unsigned numbers: 16 hex digits, or longs."""
    if values.dtype == object:
        return np.frombuffer(bytes.fromhex("".join(values)), ">u8").astype(np.uint64)
    return values.astype(np.int64).view(np.uint64)


def _slots(numbers: np.ndarray, row: int, width: int) -> np.ndarray:
    """Multiply and keep the upper bits; ``width`` is a power of two."""
    mixed = (numbers ^ (numbers >> np.uint64(31))) * _TIMES[row]
    return (mixed >> np.uint64(65 - width.bit_length())).astype(np.int64) if width > 1 else np.zeros(len(numbers), np.int64)


def _folded(hashed: DataFrame, length: int, fold: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """``length`` counters of the column ``hash``: folded in every task, blocks summed by block."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(length, np.int64)
        for batch in batches:
            fold(own, as_numbers(batch.column(0).drop_null().to_numpy(zero_copy_only=False)))
        used = [b for b in range(-(-length // BLOCK)) if own[b * BLOCK : (b + 1) * BLOCK].any()]
        for b in used:
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": [own[b * BLOCK : (b + 1) * BLOCK].tobytes()]})

    def total(group: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(c, np.int64) for c in group["counts"].to_pylist())
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int32()), "counts": [counts.tobytes()]})

    # blocks meet in two steps, so that no task holds a block of every task
    parts = hashed.mapInArrow(part, "block int, counts binary").withColumn("way", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("block", "way").applyInArrow(lambda g: total(g.drop_columns("way")), "block int, counts binary")
    out = np.zeros(length, np.int64)
    for r in some.groupBy("block").applyInArrow(total, "block int, counts binary").toLocalIterator():
        out[r.block * BLOCK : r.block * BLOCK + len(r.counts) // 8] = np.frombuffer(r.counts, np.int64)
    return out


@dataclass
class Counters:
    """A count-min table: an estimate is never too small, and too large by more than e/width of all counts with a chance of e^-rows only."""

    table: np.ndarray

    def lookup(self, numbers: np.ndarray) -> np.ndarray:
        rows, width = self.table.shape
        return np.min([self.table[r][_slots(numbers, r, width)] for r in range(rows)], axis=0)

    def merged(self, other: Counters) -> Counters:
        """The table of both inputs together."""
        return Counters(self.table + other.table)


@dataclass
class DeepHashes:
    """Ascending hashes of a known depth or more: exact, for as many as ``DEEP``."""

    hashes: np.ndarray

    def lookup(self, numbers: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, numbers), max(0, len(self.hashes) - 1))
        return self.hashes[at] == numbers if len(self.hashes) else np.zeros(len(numbers), bool)


def count_min(hashed: DataFrame, width: int = 1 << 20, rows: int = 4) -> Counters:
    """Counters of ``hashed(hash)``, whose size is ``rows * width`` whatever the input."""
    if width & (width - 1) or width < 1:
        raise ValueError("width must be a power of two")

    def fold(own: np.ndarray, numbers: np.ndarray) -> None:
        for r in range(rows):
            own[r * width : (r + 1) * width] += np.bincount(_slots(numbers, r, width), minlength=width)

    return Counters(_folded(hashed.select("hash"), rows * width, fold).reshape(rows, width))


def deep_hashes(depths: DataFrame, min_depth: int) -> DeepHashes:
    """The hashes of ``depths(hash, depth)`` that occur ``min_depth`` times or more, counted first; more than ``DEEP`` are refused (use ``count_min``)."""
    number = F.col("hash") if depths.schema["hash"].dataType.simpleString() == "bigint" else F.conv("hash", 16, -10).cast("long")
    deep = durable(depths.filter(F.col("depth") >= min_depth).select(number.alias("hash")))
    n = deep.count()
    if n > DEEP:
        raise ValueError(f"{n} deep hashes are too many to travel with every task (limit {DEEP}); use counters of fixed size")
    return DeepHashes(np.sort(as_numbers(deep.toPandas()["hash"].to_numpy())) if n else np.zeros(0, np.uint64))


def _asked(lists: pd.Series, ask: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Which values of each list ``ask`` says yes to, all lists asked at once."""
    sizes = [0 if x is None else len(x) for x in lists]
    full = [x for x in lists if x is not None and len(x)]
    said = ask(as_numbers(np.concatenate(full))) if full else np.zeros(0, bool)
    return np.split(said, np.cumsum(sizes)[:-1]) if sizes else []


def keep_deep(spark: SparkSession, known: Counters | DeepHashes, min_depth: int, name: str = "md5") -> Callable[[Column], Column]:
    """A function of a column of hash lists: their hashes that occur ``min_depth`` times or more by ``known``, in order; null stays null."""
    shared = spark.sparkContext.broadcast(known)

    @F.pandas_udf(f"array<{K.hash_type(name)}>")
    def kept(lists: pd.Series) -> pd.Series:
        found = shared.value
        said = _asked(lists, lambda n: found.lookup(n) if isinstance(found, DeepHashes) else found.lookup(n) >= min_depth)
        return pd.Series([None if x is None else x[y] for x, y in zip(lists, said)], dtype=object)

    return kept


def keeps(spark: SparkSession, known: Counters | DeepHashes, min_depth: int) -> Callable[[np.ndarray], np.ndarray]:
    """The same of an array of hashes, for functions/kmers.py ``sketch``: which of them occur ``min_depth`` times or more."""
    shared = spark.sparkContext.broadcast(known)

    def kept(numbers: np.ndarray) -> np.ndarray:
        found = shared.value
        return found.lookup(numbers) if isinstance(found, DeepHashes) else found.lookup(numbers) >= min_depth

    return kept


def keeps_slots(deep: DataFrame, slots: int) -> Callable[[np.ndarray], np.ndarray]:
    """The same by ``deep(slot)`` of ``slots`` counters (functions/kmers.py ``slot``)."""
    known = np.zeros(slots, bool)
    known[deep.select("slot").toArrow()["slot"].to_numpy()] = True
    shared = deep.sparkSession.sparkContext.broadcast(known)
    return lambda numbers: shared.value[(numbers >> np.uint64(32)) % np.uint64(slots)]


@dataclass
class ListFilter:
    """A Bloom filter: it never says no to a key of its list."""

    bits: np.ndarray
    width: int
    rows: int = 4

    def lookup(self, numbers: np.ndarray) -> np.ndarray:
        said = np.ones(len(numbers), bool)
        for r in range(self.rows):
            at = _slots(numbers, r, self.width)
            said &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return said


def list_filter(keys: DataFrame) -> ListFilter | None:
    """A filter of ``keys(hash)`` (counted first) with ``BITS`` bits a key or more; None where that is more than ``MOST_BITS``, so that its size is bounded."""
    n = max(1, keys.count())
    width = 1 << (BITS * n - 1).bit_length()
    if width > MOST_BITS:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(max(1, width >> 3), np.uint8)
        for batch in batches:
            numbers = as_numbers(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            for r in range(ListFilter.rows):
                at = _slots(numbers, r, width)
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for b in range(-(-len(own) // BLOCK)):
            if own[b * BLOCK : (b + 1) * BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": [own[b * BLOCK : (b + 1) * BLOCK].tobytes()]})

    def either(group: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["bits"].to_pylist()])
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int32()), "bits": [bits.tobytes()]})

    parts = keys.select("hash").mapInArrow(part, "block int, bits binary").withColumn("way", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("block", "way").applyInArrow(lambda g: either(g.drop_columns("way")), "block int, bits binary")
    bits = np.zeros(max(1, width >> 3), np.uint8)
    for r in some.groupBy("block").applyInArrow(either, "block int, bits binary").toLocalIterator():
        bits[r.block * BLOCK : r.block * BLOCK + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return ListFilter(bits, width)


def may_hold(spark: SparkSession, known: ListFilter) -> Callable[[Column], Column]:
    """A function of a column of lists of longs: for each of them whether the filter's list may hold it."""
    shared = spark.sparkContext.broadcast(known)

    @F.pandas_udf("array<boolean>")
    def held(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else y for x, y in zip(lists, _asked(lists, shared.value.lookup))], dtype=object)

    return held
