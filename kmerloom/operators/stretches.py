"""K-mers dealt to buckets as stretches of their text: neighbours whose minimizer (the smallest hash of the words of M letters in a k-mer) names the same bucket travel together.

A k-mer then takes three to four letters of text before they are compressed, where a hash is eight bytes that can't be; equal k-mers (with ``canonical`` those of either strand) still
meet in one bucket, where they are hashed. Two different k-mers whose 64-bit hashes agree are one within a bucket alone: of n different k-mers n^2 / 2^65 such pairs are to be expected (0.03 among a thousand million).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from kmerloom.functions import arrays as A
from kmerloom.operators.buckets import _dealt, added, counted, folded, hash_rows, narrow, one_group, planes, unplanes

#: Letters of a word; k-mers this long or longer travel as stretches (shorter ones are few, and fold before they travel); leading bits that name a bucket; letters that a task holds; letters of a block of rows.
M, LEAST, BITS, HELD, BLOCK = 7, 14, 12, 8 << 20, 4 << 20
_TIMES, _MIX, _DEAL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def loosened(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    """Narrow numbers, behind which stands their width."""
    data = loosened(data)
    return unplanes(data[:-1], f"<u{data[-1]}").astype(np.int64)


def _words(code: np.ndarray, m: int, canonical: bool) -> np.ndarray:
    """A hash of each word of m letters, the same for both strands if ``canonical``."""
    weights = [np.uint64(pow(int(_TIMES), j + 1, 1 << 64)) for j in range(m)]
    n = len(code) - m + 1
    out = sum(code[j : n + j] * weights[j] for j in range(m))
    if canonical:
        other = np.where(code < 256, A._COMPLEMENT[(code & np.uint64(255)).astype(np.uint8)], code).astype(np.uint64)
        out = np.minimum(out, sum(other[m - 1 - j : n + m - 1 - j] * weights[j] for j in range(m)))
    return (out ^ (out >> np.uint64(29))) * _MIX


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return x if size == width else np.minimum(x[: len(x) - width + size], x[width - size :])


def cut(data: np.ndarray, offsets: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, bucket, row) of the stretches of texts, in bytes; every k-mer lies in exactly one."""
    plain = not len(data) or int(data.max()) < 128
    first = np.arange(len(data)) if plain else np.flatnonzero(data & 0xC0 != 0x80)
    ends, edge = offsets if plain else np.searchsorted(first, offsets), np.append(first, len(data))
    at = np.flatnonzero(np.arange(len(first)) + k <= np.repeat(ends[1:], np.diff(ends)))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    code = data[first].astype(np.uint64)
    if not plain:
        wide, size = np.append(data, np.zeros(4, np.uint8)), np.diff(edge)
        for j in (1, 2, 3):
            code |= np.where(size > j, wide[first + j], 0).astype(np.uint64) << np.uint64(8 * j)
    m = min(M, k)
    bucket = ((_lowest(_words(code, m, canonical), k - m + 1)[at] * _DEAL) >> np.uint64(64 - BITS)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (bucket[1:] != bucket[:-1])))
    last = at[np.append(new[1:], len(at)) - 1]
    start = at[new]
    return edge[start], edge[last + k] - edge[start], bucket[new], np.searchsorted(ends, start, "right") - 1


def _rows(held: list, names: list[str]) -> pa.RecordBatch:
    """A row a bucket of what a task holds: (data, start, length, bucket, *columns) by slices."""
    shift = np.cumsum([0, *(len(h[0]) for h in held)])
    data = np.concatenate([h[0] for h in held])
    start = np.concatenate([h[1] + s for h, s in zip(held, shift.tolist())])
    length, bucket, *columns = (np.concatenate([h[i] for h in held]) for i in range(2, 4 + len(names)))
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    start, length, bucket, columns = start[order], length[order], bucket[order], [c[order] for c in columns]
    edges = np.searchsorted(bucket, np.arange((1 << BITS) + 1))
    out: dict[str, list] = {c: [] for c in ("bucket", "texts", "lengths", *(x for n in names for x in (n, f"{n}_at")))}
    for b in np.flatnonzero(np.diff(edges)).tolist():
        e = slice(edges[b], edges[b + 1])
        n = length[e]
        out["bucket"].append(b)
        out["texts"].append(squeezed(data[np.arange(n.sum()) + np.repeat(start[e] - np.cumsum(n) + n, n)].tobytes()))
        out["lengths"].append(squeezed(planes(narrow(n)) + bytes([narrow(n).itemsize])))
        for name, c in zip(names, columns):
            values, at = np.unique(c[e], return_inverse=True)
            out[name].append(squeezed(planes(values)))
            out[f"{name}_at"].append(squeezed(planes(narrow(at)) + bytes([narrow(at).itemsize])))
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "bucket" else pa.binary()) for c, v in out.items()})


def dealt(seqs: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(bucket, texts, lengths, and for every other column two binaries) of ``seqs(seq, ...)``, whose other columns are longs."""
    names = [c for c in seqs.columns if c != "seq"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = A.text_bytes(batch.column(0))
            columns = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(names))]
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + A.SLICE, "right")) - 1)
                some = data[offsets[row] : offsets[end]]
                start, length, bucket, at = cut(some, offsets[row : end + 1] - offsets[row], k, canonical)
                held.append((some.copy(), start, length, bucket, *(c[row + at] for c in columns)))
                size, row = size + len(some), end
                if size >= HELD:
                    yield _rows(held, names)
                    held, size = [], 0
        if size:
            yield _rows(held, names)

    return seqs.select("seq", *names).mapInArrow(part, ", ".join(["bucket int, texts binary, lengths binary", *(f"{n} binary, {n}_at binary" for n in names)]))


def by_bucket(rows: DataFrame) -> GroupedData:
    """The rows of each bucket, in so many partitions that the last tasks don't wait for one (few bytes are much work here, so they aren't to be put together)."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "bucket").groupBy("bucket")


def _column(letters: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(letters))


def hashed(group: pa.Table, names: list[str], k: int, numbered: bool = False, by_stretch: bool = False, **how) -> Iterator[tuple]:
    """(hashes, *columns) of all k-mers of a bucket's rows, by slices and in order; the columns as longs beside every hash, and if ``numbered`` the place of its row behind them.
    ``by_stretch``: the columns stand once a stretch, and before them a hash's place among the slice's stretches."""
    texts, lengths, columns, size, rows = [], [], [[] for _ in range(len(names) + numbered)], 0, 0

    def made() -> Iterator[tuple]:
        column = _column(b"".join(texts), np.concatenate(lengths))
        beside = [np.concatenate(c) for c in columns]
        for at, values, n in A.hashed_texts(column, [k], **how):
            beside_ = [c[at : at + len(n)] for c in beside]
            yield (values, np.repeat(np.arange(len(n)), n), *beside_) if by_stretch else (values, *(np.repeat(c, n) for c in beside_))

    for batch in group.to_batches():
        for row in batch.to_pylist():
            texts.append(loosened(row["texts"]))
            lengths.append(_numbers(row["lengths"]))
            for name, c in zip(names, columns):
                c.append(unplanes(loosened(row[name]), "<i8")[_numbers(row[f"{name}_at"])])
            if numbered:
                columns[-1].append(np.full(len(lengths[-1]), rows, np.int32))
            size, rows = size + len(texts[-1]), rows + 1
            if size >= A.SLICE:
                yield from made()
                texts, lengths, columns, size = [], [], [[] for _ in columns], 0
    if size:
        yield from made()


def depth(seqs: DataFrame, k: int, least: int = 1, **how) -> DataFrame:
    """(hash, depth) of hashes that occur ``least`` times or more in ``seqs(seq)``."""
    return totals(dealt(seqs.select("seq"), k, how.get("canonical", False)), k, least, **how)


def totals(rows: DataFrame, k: int, least: int = 1, **how) -> DataFrame:
    """(hash, depth) of the rows of ``dealt``."""

    def total(group: pa.Table) -> pa.Table:
        each = [counted(values) for values, in hashed(group, [], k, **how)]
        hashes, n = folded(np.concatenate([h for h, _ in each]), np.concatenate([m for _, m in each]), added)
        return hash_rows(hashes[n >= least], n[n >= least], "depth")

    return by_bucket(rows).applyInArrow(total, "hash string, depth long")


def unique(seqs: DataFrame, k: int, **how) -> DataFrame:
    """(code, hash) of hashes that ``seqs(code, seq)`` has under one code only (longs)."""

    def total(group: pa.Table) -> pa.Table:
        held, names = [], {0: 0}
        for values, code in hashed(group, ["code"], k, **how):
            some, at = np.unique(code, return_inverse=True)
            held.append((values, np.array([names.setdefault((c,), len(names)) for c in some.tolist()], np.int64)[at]))
        hashes, own = folded(np.concatenate([v for v, _ in held]), np.concatenate([c for _, c in held]), one_group)
        every = np.array([0, *(c[0] for c in list(names)[1:])], np.int64)
        return pa.table({"code": pa.array(every[own[own > 0]]), "hash": A.hexed(hashes[own > 0])})

    return by_bucket(dealt(seqs.select("seq", "code"), k, how.get("canonical", False))).applyInArrow(total, "code long, hash string")


def group_counts(seqs: DataFrame, k: int, sizes: tuple[int, int], panel: DataFrame | None = None, min_depth: int = 0, types: DataFrame | None = None, **how) -> DataFrame:
    """(id, level, place, shared) as buckets.py ``group_counts`` counts them, of ``seqs(id, seq)`` with ids of whole numbers; without ``panel(a, b, seq)`` the rows, which then have ``a`` and ``b`` too, are their own panel and travel once.
    With ``types(place, seq)`` (places from 1 on) also how many different hashes a row shares with each of them, at level 2.

    A bucket holds all of its k-mers of both tables, so it knows their depths and groups, and hands on a number a row, group and sub-group.
    """
    wide, canonical = sizes[1] + 1, how.get("canonical", False)
    own = (F.col("a").cast("long") * wide + F.col("b")).alias("own")
    rows = [dealt(seqs.filter("id IS NOT NULL").select("seq", F.col("id").cast("long").alias("id"), own if panel is None else F.lit(0).cast("long").alias("own")), k, canonical).withColumn("kind", F.lit(3 if panel is None else 1))]
    rows += [] if panel is None else [dealt(panel.select("seq", F.lit(0).cast("long").alias("id"), own), k, canonical).withColumn("kind", F.lit(2))]
    rows += [] if types is None else [dealt(types.select("seq", F.col("place").alias("id"), F.lit(0).cast("long").alias("own")), k, canonical).withColumn("kind", F.lit(4))]

    def one_of(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place that the panel's rows of equal hashes agree on, else 0; those of other rows are -1."""
        high = np.maximum.reduceat(places, starts)
        low = np.minimum.reduceat(places.view(np.uint32), starts).view(np.int32)  # -1 is the largest
        return np.where(low == high, low, 0).astype(np.int64)

    def pairs(a: np.ndarray, b: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs, ascending, and how many of each; ``b`` is less than ``wide``."""
        keys, n = counted((a * wide + b).astype(np.uint64))
        return *np.divmod(keys.astype(np.int64), wide), n

    alone, typed = panel is None, types is not None

    def work(group: pa.Table) -> pa.Table:
        kinds, held, of, own, kind, size = group["kind"].to_numpy(), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], 0
        for x in np.unique(kinds).tolist():
            for values, at, id_, group_ in hashed(group.filter(pa.array(kinds == x)), ["id", "own"], k, by_stretch=True, **how):
                held.append((values, at + size))
                of.append(id_)
                own.append(group_)
                kind.append(np.full(len(id_), x, np.int8))
                size += len(id_)
        values, at = (np.concatenate([h[i] for h in held]) for i in range(2))
        of, own, kind = np.concatenate(of), np.concatenate(own), np.concatenate(kind)
        names, of = np.unique(of, return_inverse=True)
        order = np.argsort(values)
        values, at = values[order], at[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
        n = np.diff(np.append(starts, len(values)))
        asks = n if alone and not typed or not len(starts) else np.add.reduceat(kind[at] & 1, starts, dtype=np.int64)
        deep = asks >= max(1, min_depth)  # the others are asked by no row, or don't count
        at, n = at[np.repeat(deep, n)], n[deep]
        starts = np.cumsum(n) - n
        if not len(starts):
            return pa.table({"id": pa.array([], pa.int64()), "own": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        place, asked = np.repeat(np.arange(len(starts)), n), kind[at] & 1 > 0
        named = kind & 2 > 0
        one = [one_of(np.where(named, x, -1).astype(np.int32)[at], starts) for x in (own // wide, own % wide)]
        groups, told = np.unique(one[0] * wide + one[1], return_inverse=True)
        member = (groups[told] > 0)[place] & asked
        at_, row, _ = pairs(place[member], of[at[member]], len(names))
        row, told, n = pairs(row, told[at_], len(groups))
        out = [(names[row], groups[told], n)]
        if typed and (of_type := kind[at] & 4 > 0).any():
            at_, type_, _ = pairs(place[of_type], of[at[of_type]], len(names))
            met = np.zeros(len(starts), bool)
            met[at_] = True
            member = met[place] & asked
            to, row, _ = pairs(place[member], of[at[member]], len(names))
            low = np.searchsorted(to, at_)
            n = np.searchsorted(to, at_, "right") - low
            row, type_, n = pairs(row[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)], np.repeat(type_, n), len(names))
            out.append((names[row], -names[type_], n))
        return pa.table({c: pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i, c in enumerate(("id", "own", "n"))})

    found = by_bucket(reduce(DataFrame.unionByName, rows)).applyInArrow(work, "id long, own long, n long")
    both = F.array(*(F.struct(F.lit(i).alias("level"), x.cast("long").alias("place")) for i, x in enumerate((F.floor(F.col("own") / wide), F.col("own") % wide))))
    levels = F.when(F.col("own") < 0, F.array(F.struct(F.lit(2).alias("level"), (-F.col("own")).alias("place")))).otherwise(both)
    each = found.select("id", F.explode(levels).alias("x"), "n").select(F.col("id").cast(seqs.schema["id"].dataType), "x.level", "x.place", "n").filter("place > 0")
    return each.groupBy("id", "level", "place").agg(F.sum("n").alias("shared"))


def _block(texts: pa.ChunkedArray, k: int, canonical: bool) -> tuple[np.ndarray, ...]:
    """(data, start, length, bucket, row) of the stretches of a block's texts, cut by slices of them."""
    data, offsets = A.text_bytes(pa.concat_arrays(texts.cast(pa.large_string()).chunks))
    each, row = [], 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + A.SLICE, "right")) - 1)
        start, length, bucket, at = cut(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], k, canonical)
        each.append((start + offsets[row], length, bucket, at + row))
        row = end
    return data, *(np.concatenate([e[i] for e in each]) for i in range(4))


def masked(seqs: DataFrame, k: int, s: int | None, min_depth: int, over: DataFrame | None = None, **how) -> DataFrame:
    """(id, sketch) as buckets.py ``masked`` makes them: of each row the s smallest hashes that occur ``min_depth`` times or more in ``over(seq)`` (the rows themselves).

    Blocks of rows send their stretches to the buckets, which hold all of their k-mers and so know their depths, and get a bit a k-mer back. The texts travel once, by block, for both steps.
    """
    canonical, alone = how.get("canonical", False), over is None
    texts = _dealt(seqs, BLOCK)

    def ask(group: pa.Table) -> pa.Table:
        rows = _rows([_block(group["seq"], k, canonical)[:4]], [])
        return pa.Table.from_batches([rows]).append_column("block", pa.array([group["block"][0].as_py()] * rows.num_rows, pa.int64()))

    rows = texts.groupBy("block").applyInArrow(ask, "bucket int, texts binary, lengths binary, block long")
    rows = rows if alone else rows.unionByName(dealt(over.select("seq"), k, canonical).withColumn("block", F.lit(-1).cast("long")))

    def reply(group: pa.Table) -> pa.Table:
        blocks = group["block"].to_numpy()
        values, row = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int32)), *hashed(group, [], k, numbered=True, **how)))
        order = np.argsort(values)
        sorted_ = values[order]
        starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(values)])
        deep = np.zeros(len(values), bool)
        if len(starts):
            n = np.diff(np.append(starts, len(values)))
            depths = n if alone else np.add.reduceat((blocks < 0)[row[order]].astype(np.int64), starts)
            deep[order] = np.repeat(depths >= min_depth, n)
        ends = np.cumsum(np.bincount(row, minlength=len(blocks))).tolist()
        asked = np.flatnonzero(blocks >= 0).tolist()
        bits = [np.packbits(deep[ends[i - 1] if i else 0 : ends[i]]).tobytes() for i in asked]
        return pa.table({"block": pa.array(blocks[asked], pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()] * len(asked), pa.int32()), "reply": pa.array(bits, pa.binary())})

    def sketched(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"id": texts["id"], "sketch": pa.array([], pa.list_(pa.string()))})
        data, start, length, bucket, row = _block(texts["seq"], k, canonical)
        order = np.argsort(bucket.astype(np.uint16), kind="stable")  # as the buckets have them
        start, length, bucket, row = start[order], length[order], bucket[order], row[order]
        kept, counts, ends, at = [np.zeros(0, np.uint64)], np.zeros(len(row), np.int64), np.append(0, np.cumsum(length)), 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + A.SLICE, "right")) - 1)
            n = length[at:to]
            letters = data[np.arange(n.sum()) + np.repeat(start[at:to] - np.cumsum(n) + n, n)]
            for i, values, m in A.hashed_texts(_column(letters, n), [k], **how):
                kept.append(values)
                counts[at + i : at + i + len(m)] = m
            at = to
        each = np.bincount(bucket, weights=counts, minlength=1 << BITS).astype(np.int64).tolist()
        told = dict(zip(replies["bucket"].to_pylist(), replies["reply"].to_pylist()))
        bits = [np.unpackbits(np.frombuffer(told[b], np.uint8), count=each[b]) for b in np.flatnonzero(each).tolist()]
        deep = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
        values, owner = np.concatenate(kept)[deep], np.repeat(row, counts)[deep]
        v, m = A.smallest(values[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=texts.num_rows), s)
        return pa.table({"id": texts["id"], "sketch": A.listed(A.hexed(v), m)})

    kind = seqs.schema["id"].dataType.simpleString()
    return texts.groupBy("block").cogroup(by_bucket(rows).applyInArrow(reply, "block long, bucket int, reply binary").groupBy("block")).applyInArrow(sketched, f"id {kind}, sketch array<string>")
