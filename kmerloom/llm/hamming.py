"""Exact search among 64-bit fingerprints within a Hamming radius, in a bounded number of rows a task.

Pigeonhole: cut the 64 bits into ``blocks`` blocks; two fingerprints that differ in at most r bits agree in at least
``blocks - r`` of them, so for each choice of that many blocks there is one permuted table keyed by the chosen bits, and
every pair within the radius meets in some table. Each bucket (table, key) is compared in tiles of rows sorted by population
count, by exclusive or and bit counts of whole tiles; tile pairs whose population counts differ by more than r are skipped. A bucket
with more than ``TILE`` rows is dealt to several tasks by the same rule: tiles of one population count each, a task a tile pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a tile holds at most on average; one task compares at most two tiles at a time.
TILE = 4096
#: numpy compares so many rows of a tile with the other tile at once.
STRIP = 256


def plan_blocks(n: int, radius: int) -> tuple[list[tuple[int, int]], int]:
    """Blocks as (shift, width) and how many of them must agree: the fewest tables whose buckets keep about 1000 rows or fewer when bits are even."""
    for agree in range(1, 4):
        blocks = radius + agree
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        if n <= 1000 << (64 * agree // blocks):
            break
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], agree


def table_keys(fp: Column, blocks: list[tuple[int, int]], agree: int) -> Column:
    """array<struct<t int, key long>>: the key of the fingerprint in each permuted table (the chosen blocks lead)."""
    keys = []
    for t, chosen in enumerate(combinations(range(len(blocks)), agree)):
        key: Column | None = None
        for b in chosen:
            shift, width = blocks[b]
            part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
            key = part if key is None else F.shiftleft(key, width).bitwiseOR(part)
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.array(*keys)


def in_buckets(points: DataFrame, radius: int, n: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray, int], list[tuple]], schema: str) -> DataFrame:
    """Runs ``work(table, fps, ids, sides)`` on every bucket or tile pair of ``points(fp long, id long)``, distinct in fp.

    ``sides`` per row: 0 for the left tile, 1 for the right tile, 2 when bucket or tile is compared with itself. Each pair within
    the radius meets in each table it agrees in, exactly once there.
    """
    assert 0 <= radius <= WIDEST
    blocks, agree = plan_blocks(n, radius)
    keyed = points.select("fp", "id", F.explode(table_keys(F.col("fp"), blocks, agree)).alias("k")).select("k.t", "k.key", F.bit_count("fp").alias("pop"), "fp", "id")
    sizes = keyed.groupBy("t", "key", "pop").agg(F.count("*").alias("m"))
    big = sizes.groupBy("t", "key").agg(F.sum("m").alias("all")).filter(F.col("all") > TILE).select("t", "key")
    light = keyed.join(big, ["t", "key"], "left_anti").select("t", "key", F.lit(0).alias("p1"), F.lit(0).alias("s1"), F.lit(0).alias("p2"), F.lit(0).alias("s2"), F.lit(2).alias("side"), "fp", "id")
    if big.limit(1).count():  # tile pairs of heavy buckets
        cut = sizes.join(big, ["t", "key"], "left_semi").withColumn("salts", F.ceil(F.col("m") / TILE).cast("int"))
        tiles = cut.select("t", "key", "pop", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
        left, right = (tiles.select("t", "key", F.col("pop").alias(f"p{i}"), F.col("s").alias(f"s{i}")) for i in "12")
        pairs = left.join(right, ["t", "key"]).filter((F.col("p2") - F.col("p1")).between(0, radius) & ((F.col("p1") < F.col("p2")) | (F.col("s1") <= F.col("s2"))))
        sides = pairs.select("*", F.explode(F.when((F.col("p1") == F.col("p2")) & (F.col("s1") == F.col("s2")), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
        sides = sides.withColumns({"pop": F.when(F.col("side") == 1, F.col("p2")).otherwise(F.col("p1")), "s": F.when(F.col("side") == 1, F.col("s2")).otherwise(F.col("s1"))})
        salted = keyed.join(cut.select("t", "key", "pop", "salts"), ["t", "key", "pop"]).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
        heavy = salted.join(sides, ["t", "key", "pop", "s"]).select(*light.columns)
        light = light.unionByName(heavy)
    group = ["t", "key", "p1", "s1", "p2", "s2"]
    return light.repartition(*group).sortWithinPartitions(*group, "fp").mapInArrow(lambda batches: _groups(batches, work, schema_of(schema)), schema)


def schema_of(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return [(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(","))]


def _groups(batches: Iterator[pa.RecordBatch], work: Callable, fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted stream into its groups; the open group at a batch's end waits for the next batch."""
    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [c.to_numpy(zero_copy_only=False) for c in batch.columns]

    def flush(cols: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        table, side, fps, ids = cols[0], cols[6], cols[7].view(np.uint64), cols[8]
        for a, b in _linked_groups(fps, ends):
            out += work(int(table[a]), fps[a:b], ids[a:b], side[a:b])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out), fields)], names=[f for f, _ in fields])

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = columns(batch)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        changed = np.zeros(len(cols[0]) - 1, bool) if len(cols[0]) else np.zeros(0, bool)
        for c in cols[:6]:
            changed |= c[1:] != c[:-1]
        ends = np.flatnonzero(changed) + 1
        if len(ends):
            yield from flush([c[: ends[-1]] for c in cols], ends)
            held = [c[ends[-1] :] for c in cols]
        else:
            held = cols
    if held is not None and len(held[0]):
        yield from flush(held, np.array([len(held[0])]))


#: Groups up to this size are one tile each; many of them are compared at once, rows at every distance in the sorted stream, and only those with a pair within the largest radius in use go on.
SMALL, WIDEST = 48, 3


def _linked_groups(fps: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the groups that may hold a pair within the radius: all large ones, and small ones with such a pair."""
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    group = np.repeat(np.arange(len(ends)), sizes)
    hit = sizes > SMALL
    small = np.flatnonzero(~hit[group])  # rows of small groups, still in order
    f, g = fps[small], group[small]
    for d in range(1, min(SMALL, int(sizes[~hit].max(initial=1)))):
        same = np.flatnonzero(g[d:] == g[:-d])
        near = same[np.bitwise_count(f[same + d] ^ f[same]) <= WIDEST]
        hit[g[near]] = True
    for i in np.flatnonzero(hit):
        yield int(begins[i]), int(ends[i])


def near_tiles(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, places) of all pairs within the radius of ``fps``, which are sorted by population count: tile by tile of STRIP rows,
    exclusive or and bit counts of a whole tile pair at once. Tile pairs whose population counts differ beyond the radius are skipped."""
    pops = np.bitwise_count(fps).astype(np.int16)
    for i in range(0, len(fps), STRIP):
        last = pops[min(i + STRIP, len(fps)) - 1]
        for j in range(i, int(np.searchsorted(pops, last + radius, "right")), STRIP):
            near = np.bitwise_count(fps[i : i + STRIP, None] ^ fps[None, j : j + STRIP]) <= radius
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(x):
                yield x + i, y + j


def forest(radius: int) -> Callable:
    """Work that returns links (id, id) of a spanning forest of the group's near pairs: fewer links than rows."""

    def work(table: int, fps: np.ndarray, ids: np.ndarray, sides: np.ndarray) -> list[tuple]:
        order = np.argsort(np.bitwise_count(fps), kind="stable")
        fps, ids = fps[order], ids[order]
        tree, out = np.arange(len(fps)), []
        for x, y in near_tiles(fps, radius):
            apart = tree[x] != tree[y]
            x, y = x[apart], y[apart]
            if len(x):  # one pair of each two trees will do
                low, high = np.minimum(tree[x], tree[y]), np.maximum(tree[x], tree[y])
                for k in np.unique(low * len(fps) + high, return_index=True)[1].tolist():
                    u, v = tree[x[k]], tree[y[k]]
                    if u != v:
                        tree[tree == v] = u
                        out.append((int(ids[x[k]]), int(ids[y[k]])))
        return out

    return work


def counts(radius: int, n: int) -> Callable:
    """Work that returns (id, partners within the radius): a pair counts only in the first table in which it agrees."""
    blocks, agree = plan_blocks(n, radius)
    choices = list(combinations(range(len(blocks)), agree))
    masks = [np.uint64(sum(((1 << w) - 1) << s for s, w in (blocks[b] for b in c))) for c in choices]

    def work(table: int, fps: np.ndarray, ids: np.ndarray, sides: np.ndarray) -> list[tuple]:
        total = np.zeros(len(fps), np.int64)
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        pops = np.bitwise_count(fps).astype(np.int16)
        left, right = left[np.argsort(pops[left], kind="stable")], right[np.argsort(pops[right], kind="stable")]
        for i in range(0, len(left), STRIP):
            rows = left[i : i + STRIP]
            window = right[np.searchsorted(pops[right], pops[rows[0]] - radius) : np.searchsorted(pops[right], pops[rows[-1]] + radius, "right")]
            differ = fps[rows][:, None] ^ fps[window][None, :]
            near = np.bitwise_count(differ) <= radius
            near &= rows[:, None] != window[None, :]
            for m in masks[:table]:
                near &= (differ & m) != 0
            total[rows] += near.sum(1)
            if len(sides) and sides[0] != 2:
                total[window] += near.sum(0)
        return [(int(ids[i]), int(total[i])) for i in np.flatnonzero(total)]

    return work
