"""Near-duplicates by SimHash with an exact Jaccard check: blocks from fingerprints within a few bits, and from MinHash bands for like texts that lie further apart; shared shingles counted in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from kmerloom.llm.common import arrow_map, durable
from kmerloom.llm.components import components
from kmerloom.llm.neardup import links, majority, shingle_hashes

#: Fingerprints that differ in so many bits at most are linked, as in op10.
RADIUS = 3
#: A pair of similarity 0.8 agrees in none of the bands with a chance of (1 - 0.8^6)^48, 5 in ten million; more alike ones, less.
BANDS, ROWS = 48, 6
#: Shingles of a tile: TILE in blocks of up to TILES of them; in larger blocks more, up to FULL.
TILE, TILES, FULL = 1 << 15, 16, 1 << 22

_rng = np.random.default_rng(42)
_xor, _times = _rng.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_times |= np.uint64(1)
_join = _rng.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: the smallest of the set's hashes under each of its permutations, folded."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[None, i : i + 512] ^ _xor) * _times).min(1), out=least)
    return (least.reshape(BANDS, ROWS) * _join).sum(1, dtype=np.uint64)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, same, n, fp, keys): digest and size of the shingle set, its fingerprint and its band keys."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t, width) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "same": [xxh3_128_digest(s.tobytes()) for s in sets], "n": list(map(len, sets)), "fp": majority(sets).view(np.int64), "keys": [band_keys(s).view(np.int64) for s in sets]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, same binary, n long, fp long, keys array<long>")


def like(left: list[np.ndarray], right: list[np.ndarray], least: tuple[int, int]) -> Iterator[np.ndarray]:
    """For each set of ``left`` the places in ``right`` of all sets whose Jaccard similarity is ``least`` or more, counted exactly."""
    sizes = np.array([len(s) for s in right], np.int64)
    flat, own = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    for s in left:
        at = np.searchsorted(flat, s)
        n = np.searchsorted(flat, s, "right") - at
        places = np.arange(n.sum()) + np.repeat(at - np.cumsum(n) + n, n)
        both = np.bincount(own[places], minlength=len(right))
        yield np.flatnonzero((both * least[1] >= least[0] * (len(s) + sizes - both)) & (both > 0))


def _links(least: tuple[int, int]):
    """Links of a spanning forest of a tile's near pairs, or of those between two tiles."""

    def work(group: pa.Table) -> pa.Table:
        first = group["tile"].to_numpy() == group["low"][0].as_py()
        ids, sets = group["id"].to_numpy(), [np.frombuffer(b, np.uint64) for b in group["shingles"].to_pylist()]
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        if group["low"][0].as_py() == group["high"][0].as_py():
            right = left
        parent, out = list(range(len(sets))), []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        if len(left) and len(right):
            for i, near in zip(left.tolist(), like([sets[i] for i in left], [sets[i] for i in right], least)):
                for j in right[near].tolist():
                    a, b = root(i), root(j)
                    if a != b:
                        parent[b] = a
                        out.append((int(ids[i]), int(ids[j])))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return work


def alike(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between the ``points(id, fp)`` whose fingerprints are equal or within ``radius`` bits, enough to join all of them."""
    prints = durable(points.groupBy("fp").agg(F.min("id").alias("id")))
    equal = points.select("fp", F.col("id").alias("v")).join(prints.withColumnRenamed("id", "u"), "fp").filter("u < v").select("u", "v")
    return equal.unionByName(links(prints, radius))


def blocks(points: DataFrame) -> DataFrame:
    """(id, root, n) of ``points(id, n, fp, keys)`` whose fingerprint is near another's or that share a band key with it, directly or by others; ``root`` names the block."""
    keys = points.select("id", F.explode("keys").alias("key"))
    least = keys.groupBy("key").agg(F.min("id").alias("u"), F.max("id").alias("last")).filter("u < last").select("key", "u")
    banded = keys.join(least, "key").filter("id > u").select(F.col("id").alias("v"), "u").distinct()
    coarse = components(alike(points).unionByName(banded))
    members = coarse.unionByName(coarse.select(F.col("root").alias("id"), "root").distinct())
    return members.join(points.groupBy("id").agg(F.sum("n").alias("n")), "id")


def near_duplicates(docs: DataFrame, least: tuple[int, int] = (4, 5), width: int = 5) -> DataFrame:
    """(id, root): documents that aren't the smallest id of their component, and that id. Linked are documents whose sets of
    ``width``-word shingles have a Jaccard similarity of ``least`` (a fraction) or more.

    Equal sets fold into one point, by a link to the smallest id each. Points meet in blocks: components of a graph of all SimHash
    links (every pair within ``RADIUS`` bits, exact) and, for like texts beyond them, one link a point and band key. Only members of blocks are read again for their sets; a block is cut into tiles, every pair of
    tiles counts its pairs' common shingles exactly and returns a spanning forest. Texts without a word are copies of each other;
    null ids link nothing; rows of one id are one document.
    """
    prints = durable(signatures(docs, width).filter(F.col("doc_id").isNotNull()))
    points = durable(prints.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    copies = prints.join(points.select("same", "id"), "same").filter("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    members = durable(blocks(points.filter("n > 0")))
    size = F.col("size")
    tiles = members.groupBy("root").agg(F.sum("n").alias("size")).select("root", F.least(F.ceil(size / TILE), F.greatest(F.lit(TILES), F.ceil(size / FULL))).cast("int").alias("tiles"))
    members = members.join(tiles, "root").select("id", "root", "tiles", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"))

    def sets(batch: dict[str, list]) -> dict[str, list]:
        return {**{c: batch[c] for c in ("id", "root", "tiles", "tile")}, "shingles": [shingle_set(t, width).tobytes() for t in batch["text"]]}

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(members, "id")
    dealt = arrow_map(texts, sets, "id long, root long, tiles int, tile int, shingles binary")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("id", "root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "shingles")
    links = dealt.groupBy("root", "low", "high").applyInArrow(_links(least), "u long, v long")
    return components(copies.unionByName(links))


def one_of_each(docs: DataFrame, least: tuple[int, int] = (4, 5), width: int = 5) -> DataFrame:
    """``docs`` without those that a document of a smaller id stands for; all columns stay, and all rows without an id."""
    gone = near_duplicates(docs, least, width)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))  # a row travels in one struct, whatever its columns are called
    return rows.join(gone, "id", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
