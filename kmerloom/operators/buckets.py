"""Folding all k-mers of a table by hash: tasks fold their own, sorted hashes travel in blocks by their leading bits, each bucket is folded by one task.

A block is a row a bucket: hashes byte by byte (of sorted ones the upper bytes shrink to nothing when Spark compresses its shuffle), and beside them
counts or groups. Hashes are those of functions/arrays.py; equal ones are one, as everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import arrays as A

#: Leading bits that name a bucket; hashes that a task holds before it folds them, and rows that it hands on at once.
BITS, HELD, ROWS = 12, 4 << 20, 1 << 20
Fold = Callable[[np.ndarray, np.ndarray], np.ndarray]


def planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as hold the largest."""
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def added(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def folded(hashes: np.ndarray, beside: np.ndarray, fold: Fold) -> tuple[np.ndarray, np.ndarray]:
    """Hashes once each, ascending, with what ``fold(values, starts)`` makes of the values beside equal ones, in any order."""
    order = np.argsort(hashes)
    hashes, beside = hashes[order], beside[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[starts], fold(beside, starts) if len(starts) else beside


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.sort(hashes)
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[starts], np.diff(np.append(starts, len(hashes)))


def blocks(hashes: np.ndarray, beside: np.ndarray, **more) -> pa.RecordBatch:
    """The rows of sorted hashes."""
    edges = np.append(np.searchsorted(hashes, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS)), len(hashes))
    used = np.flatnonzero(np.diff(edges))
    each = [(slice(edges[b], edges[b + 1])) for b in used.tolist()]
    side = [narrow(beside[e]) for e in each]
    table = {"bucket": pa.array(used, pa.int32()), "hashes": pa.array([planes(hashes[e]) for e in each], pa.binary()), "beside": pa.array([planes(x) for x in side], pa.binary())}
    return pa.RecordBatch.from_pydict(table | {c: pa.array([v] * len(used), t) for c, (v, t) in more.items()})


def opened(hashes: bytes, beside: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block and the numbers beside them."""
    return unplanes(hashes, "<u8"), unplanes(beside, f"<u{8 * len(beside) // max(1, len(hashes))}").astype(np.int64)


def hash_rows(hashes: np.ndarray, beside: np.ndarray, name: str) -> pa.Table:
    return pa.table({"hash": A.hexed(hashes), name: pa.array(beside, pa.int64())})


def counts(seqs: DataFrame, ks: list[int], **how) -> DataFrame:
    """(bucket, hashes, beside): occurrences in ``seqs(seq)``. A task that sees few different hashes keeps counting them; else what it holds goes on in blocks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for _, values, _ in A.hashed_texts(batch.column(0), ks, **how):
                new.append(values)
                size += len(values)
                if size >= HELD:
                    some, m = counted(np.concatenate(new))
                    known, n = folded(np.concatenate([known, some]), np.concatenate([n, m]), added)
                    new, size = [], 0
                    if len(known) > HELD // 2:
                        yield blocks(known, n)
                        known, n = known[:0], n[:0]
        some, m = counted(np.concatenate(new)) if new else (known[:0], n[:0])
        known, n = folded(np.concatenate([known, some]), np.concatenate([n, m]), added)
        if len(known):
            yield blocks(known, n)

    return seqs.select("seq").mapInArrow(part, "bucket int, hashes binary, beside binary")


def depth(seqs: DataFrame, ks: list[int], least: int = 1, **how) -> DataFrame:
    """(hash, depth) of hashes that occur ``least`` times or more in ``seqs(seq)``."""
    return totals(counts(seqs, ks, **how), least)


def totals(rows: DataFrame, least: int = 1) -> DataFrame:
    """(hash, depth) of the blocks of ``counts``."""

    def total(group: pa.Table) -> pa.Table:
        each = [opened(h, b) for h, b in zip(group["hashes"].to_pylist(), group["beside"].to_pylist())]
        hashes, n = folded(np.concatenate([h for h, _ in each]), np.concatenate([b for _, b in each]), added)
        return hash_rows(hashes[n >= least], n[n >= least], "depth")

    return rows.groupBy("bucket").applyInArrow(total, "hash string, depth long")


def slot_depth(seqs: DataFrame, ks: list[int], slots: int, **how) -> DataFrame:
    """(slot, depth) of the counters of K.slot; a task hands on a row a counter it has used."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def taken() -> tuple[np.ndarray, np.ndarray]:
            some, m = counted(np.concatenate(new)) if new else (known[:0], n[:0])
            return folded(np.concatenate([known, some]), np.concatenate([n, m]), added)

        for batch in batches:
            for _, values, _ in A.hashed_texts(batch.column(0), ks, **how):
                new.append((values >> np.uint64(32)) % np.uint64(slots))
                size += len(values)
                if size >= HELD:
                    known, n = taken()
                    new, size = [], 0
        known, n = taken()
        for i in range(0, len(known), ROWS):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(known[i : i + ROWS].astype(np.int64)), "n": pa.array(n[i : i + ROWS])})

    made = seqs.select("seq").mapInArrow(part, "slot long, n long")
    return made.groupBy("slot").agg(F.sum("n").alias("depth"))


def one_group(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The group of equal hashes; 0 where they have several, or had."""
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    return np.where(low == high, low, 0)


def two_groups(wide: int) -> Fold:
    """The same of two groups in one number, the first times ``wide``."""
    return lambda values, starts: one_group(values // wide, starts) * wide + one_group(values % wide, starts)


def depth_among(seqs: DataFrame, ks: list[int], among: DataFrame, **how) -> DataFrame:
    """(hash, depth) of those hashes of ``among(hash)``, which was counted, that ``seqs(seq)`` has; a task hands on a row a hash."""
    found, ok = A.numbers(among.select("hash").toArrow()["hash"].combine_chunks())
    wanted = seqs.sparkSession.sparkContext.broadcast(A.distinct(found[ok]))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = wanted.value
        some, n = np.zeros(1 << 22, bool), np.zeros(len(asked), np.int64)
        some[asked >> np.uint64(42)] = True
        for batch in batches:
            for _, values, _ in A.hashed_texts(batch.column(0), ks, **how):
                values = values[some[values >> np.uint64(42)]]
                at = np.minimum(np.searchsorted(asked, values), max(0, len(asked) - 1))
                n += np.bincount(at[asked[at] == values], minlength=len(asked)) if len(values) else 0
        used = np.flatnonzero(n)
        for i in range(0, len(used), ROWS):
            yield pa.RecordBatch.from_pydict({"hash": A.hexed(asked[used[i : i + ROWS]]), "n": pa.array(n[used[i : i + ROWS]])})

    return seqs.select("seq").mapInArrow(part, "hash string, n long").groupBy("hash").agg(F.sum("n").alias("depth"))


def unique(seqs: DataFrame, ks: list[int], among: DataFrame | None = None, **how) -> DataFrame:
    """(code, hash) of hashes that ``seqs(code, seq)`` has under one code only (longs). With ``among(hash)``, which was counted, only those are asked for and only they travel.

    Beside the hashes of a block stand places in its list of codes, from 1 on; 0 stands for several.
    """
    wanted = None
    if among is not None:
        found, ok = A.numbers(among.select("hash").toArrow()["hash"].combine_chunks())
        wanted = seqs.sparkSession.sparkContext.broadcast(A.distinct(found[ok]))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None
        if wanted is not None:
            asked = wanted.value
            some = np.zeros(1 << 22, bool)
            some[asked >> np.uint64(42)] = True
        hashes, at, new, size, codes = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, {}

        def taken() -> tuple[np.ndarray, np.ndarray]:
            return folded(np.concatenate([hashes, *(v for v, _ in new)]), np.concatenate([at, *(c for _, c in new)]), one_group)

        def handed() -> pa.RecordBatch:
            return blocks(hashes, at, codes=(np.array(list(codes), np.int64).tobytes(), pa.binary()))

        for batch in batches:
            own = np.array([codes.setdefault(c, len(codes) + 1) for c in batch.column(0).to_pylist()], np.int64)
            for row, values, n in A.hashed_texts(batch.column(1), ks, **how):
                owner = np.repeat(own[row : row + len(n)], n)
                if some is not None:
                    may = np.flatnonzero(some[values >> np.uint64(42)])
                    may = may[asked[np.minimum(np.searchsorted(asked, values[may]), len(asked) - 1)] == values[may]]
                    values, owner = values[may], owner[may]
                new.append((values, owner))
                size += len(values)
                if size >= HELD:
                    hashes, at = taken()
                    new, size = [], 0
                    if len(hashes) > HELD // 2:
                        yield handed()
                        hashes, at = hashes[:0], at[:0]
        hashes, at = taken()
        if len(hashes):
            yield handed()

    def total(group: pa.Table) -> pa.Table:
        hashes, own, names = [], [], {0: 0}
        for h, b, c in zip(*(group[x].to_pylist() for x in ("hashes", "beside", "codes"))):
            v, at = opened(h, b)
            hashes.append(v)
            own.append(np.array([0, *(names.setdefault((x,), len(names)) for x in np.frombuffer(c, np.int64).tolist())], np.int64)[at])
        v, at = folded(np.concatenate(hashes), np.concatenate(own), one_group)
        every = np.array([0, *(k[0] for k in list(names)[1:])], np.int64)
        return pa.table({"code": pa.array(every[at[at > 0]]), "hash": A.hexed(v[at > 0])})

    made = seqs.select("code", "seq").mapInArrow(part, "bucket int, hashes binary, beside binary, codes binary")
    return made.groupBy("bucket").applyInArrow(total, "code long, hash string")


# --- rows that ask about their own hashes: blocks of rows send theirs to the buckets, and get a number for each back

#: Characters of a block.
BLOCK = 4 << 20
_ROWS = "bucket int, block long, kind int, hashes binary, beside binary"
_ASK, _DEEP, _GROUP = 0, 1, 2


def _dealt(seqs: DataFrame, size: int | None = None) -> DataFrame:
    """``seqs(id, seq)`` with ``block``: rows of about ``size`` characters (``BLOCK``), settled by the row itself, so that it is the same whenever it is made."""
    chars = seqs.agg(F.sum(F.length("seq"))).first()[0] or 0
    n = max(chars // (size or BLOCK) + 1, seqs.sparkSession.sparkContext.defaultParallelism)
    return seqs.select("id", "seq", F.pmod(F.xxhash64("id", "seq"), F.lit(n)).alias("block"))


def _held(column: pa.ChunkedArray | pa.Array, ks: list[int], how: dict) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a block's texts and how many each text has."""
    column = column.cast(pa.large_string())
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    each = list(A.hashed_texts(column, ks, **how))
    return np.concatenate([v for _, v, _ in each]), np.concatenate([n for _, _, n in each])


def _asks(dealt: DataFrame, ks: list[int], how: dict) -> DataFrame:
    def ask(group: pa.Table) -> pa.Table:
        made = blocks(*counted(_held(group["seq"], ks, how)[0]), block=(group["block"][0].as_py(), pa.int64()), kind=(_ASK, pa.int32()))
        return pa.Table.from_batches([made]).select(["bucket", "block", "kind", "hashes", "beside"])

    return dealt.groupBy("block").applyInArrow(ask, _ROWS)  # with all columns, so that the texts' one exchange serves the rows' last step too


def _source(rows: DataFrame, kind: int) -> DataFrame:
    return rows.select("bucket", F.lit(-1).cast("long").alias("block"), F.lit(kind).alias("kind"), "hashes", "beside")


def _replied(rows: DataFrame, known: Callable[[dict], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(block, bucket, reply): for each hash of a block's rows the number beside it in ``known`` (ascending hashes and numbers, from what a bucket holds by kind), else 0."""

    def work(group: pa.Table) -> pa.Table:
        held: dict = {}
        for block, kind, h, b in zip(*(group[c].to_pylist() for c in ("block", "kind", "hashes", "beside"))):
            held.setdefault(kind, []).append((block, *opened(h, b)))
        hashes, numbers = known(held)
        replies = []
        for _, asked, _ in held.get(_ASK, []):
            at = np.minimum(np.searchsorted(hashes, asked), max(0, len(hashes) - 1))
            replies.append(planes(narrow(np.where(hashes[at] == asked, numbers[at], 0))) if len(hashes) else bytes(len(asked)))
        blocks_ = [b for b, _, _ in held.get(_ASK, [])]
        return pa.table({"block": pa.array(blocks_, pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()] * len(blocks_), pa.int32()), "reply": pa.array(replies, pa.binary())})

    return rows.groupBy("bucket").applyInArrow(work, "block long, bucket int, reply binary")


def _told(texts: pa.Table, replies: pa.Table, ks: list[int], how: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, numbers, counts) of a block's texts."""
    values, counts = _held(texts["seq"], ks, how)
    order = np.argsort(values)
    new = np.append(True, values[order[1:]] != values[order[:-1]])[: len(values)]
    every, place = values[order[new]], np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    edges = np.searchsorted(every, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS)).tolist() + [len(every)]
    told = np.zeros(len(every), np.int64)
    for b, r in zip(replies["bucket"].to_pylist(), replies["reply"].to_pylist()):
        told[edges[b] : edges[b + 1]] = unplanes(r, f"<u{len(r) // (edges[b + 1] - edges[b])}")
    return values, told[place], counts


def _sum(held: list) -> tuple[np.ndarray, np.ndarray]:
    return folded(np.concatenate([h for _, h, _ in held]), np.concatenate([n for _, _, n in held]), added)


def masked(seqs: DataFrame, ks: list[int], s: int | None, min_depth: int, over: DataFrame | None = None, depths: DataFrame | None = None, **how) -> DataFrame:
    """(id, sketch): of each row the s smallest hashes that occur ``min_depth`` times or more in ``over(seq)`` (the rows themselves), or by ``depths(hash, depth)``.

    What travels is each block's different hashes, a byte or less for each of them back, and the texts by block; no k-mer is a row.
    """
    dealt = _dealt(seqs)
    rows = _asks(dealt, ks, how)
    if depths is not None:

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, ok = A.numbers(batch.column(0))
                values = np.sort(values[ok])
                yield blocks(values, np.ones(len(values), np.int64))

        rows = rows.unionByName(_source(depths.filter(F.col("depth") >= min_depth).select("hash").mapInArrow(part, "bucket int, hashes binary, beside binary"), _DEEP))
    elif over is not None:
        rows = rows.unionByName(_source(counts(over, ks, **how), _DEEP))

    source_kind, least = _ASK if depths is None and over is None else _DEEP, min_depth if depths is None else 1

    def known(held: dict) -> tuple[np.ndarray, np.ndarray]:
        source = held.get(source_kind, [])
        if not source:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes, n = _sum(source)
        hashes = hashes[n >= least]
        return hashes, np.ones(len(hashes), np.int64)

    def sketched(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"id": texts["id"], "sketch": pa.array([], pa.list_(pa.string()))})
        values, told, n = _told(texts, replies, ks, how)
        kept = told > 0
        v, m = A.smallest(values[kept], np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(n)])]), s)
        return pa.table({"id": texts["id"], "sketch": A.listed(A.hexed(v), m)})

    kind = seqs.schema["id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(_replied(rows, known).groupBy("block")).applyInArrow(sketched, f"id {kind}, sketch array<string>")


def group_counts(seqs: DataFrame, ks: list[int], panel: DataFrame, sizes: tuple[int, int], panel_ks: list[int], min_depth: int = 0, **how) -> DataFrame:
    """(id, level, place, shared): of each row of ``seqs`` how many different hashes it shares with the own hashes of each group of ``panel(a, b, seq)``, at both levels (0, 1).

    ``a`` and ``b`` are a sequence's groups as places from 1 on (up to ``sizes``; 0: none). A hash is a group's own when no other group of that level has it. Of the rows' hashes those of
    ``min_depth`` occurrences or more count.
    """
    dealt, wide = _dealt(seqs), sizes[1] + 1
    one = two_groups(wide)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def taken() -> tuple[np.ndarray, np.ndarray]:
            return folded(np.concatenate([hashes, *(v for v, _ in new)]), np.concatenate([at, *(c for _, c in new)]), one)

        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64) * wide + batch.column(1).to_numpy()
            for row, values, n in A.hashed_texts(batch.column(2), panel_ks, **how):
                new.append((values, np.repeat(own[row : row + len(n)], n)))
                size += len(values)
                if size >= HELD:
                    hashes, at = taken()
                    new, size = [], 0
                    if len(hashes) > HELD // 2:
                        yield blocks(hashes, at)
                        hashes, at = hashes[:0], at[:0]
        hashes, at = taken()
        if len(hashes):
            yield blocks(hashes, at)

    def known(held: dict) -> tuple[np.ndarray, np.ndarray]:
        if not held.get(_GROUP) or not held.get(_ASK):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes, at = folded(np.concatenate([h for _, h, _ in held[_GROUP]]), np.concatenate([c for _, _, c in held[_GROUP]]), one)
        if min_depth:
            all_, n = _sum(held[_ASK])
            deep = all_[n >= min_depth]
            both = np.isin(hashes, deep, assume_unique=True)
            hashes, at = hashes[both], at[both]
        return hashes, at

    def shared(texts: pa.Table, replies: pa.Table) -> pa.Table:
        values, told, n = _told(texts, replies, ks, how) if texts.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        some = np.flatnonzero(told)
        row = np.repeat(np.arange(len(n)), n)[some]
        order = np.lexsort((values[some], row))
        row, value, told = row[order], values[some][order], told[some][order]
        first = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else np.zeros(0, bool)
        out = []
        for level, place in ((0, told[first] // wide), (1, told[first] % wide)):
            keys, m = np.unique(row[first][place > 0] * (max(sizes) + 1) + place[place > 0], return_counts=True)
            out.append(pa.table({"id": texts["id"].take(pa.array(keys // (max(sizes) + 1))), "level": pa.array(np.full(len(keys), level), pa.int32()), "place": pa.array(keys % (max(sizes) + 1), pa.int64()), "shared": pa.array(m, pa.int64())}))
        return pa.concat_tables(out)

    rows = _asks(dealt, ks, how).unionByName(_source(panel.select("a", "b", "seq").mapInArrow(part, "bucket int, hashes binary, beside binary"), _GROUP))
    kind = seqs.schema["id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(_replied(rows, known).groupBy("block")).applyInArrow(shared, f"id {kind}, level int, place long, shared long")
