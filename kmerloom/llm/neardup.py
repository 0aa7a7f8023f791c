"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison, grouped by components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kmerloom.llm import hamming
from kmerloom.llm.common import arrow_map, durable
from kmerloom.llm.components import components


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle: A-Z lower-cased, words cut at ASCII white space, repeats included; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only x20 and x09-x0D cut
    n = max(len(words) - width + 1, min(1, len(words)))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)] * n
    return np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, n)


def majority(hashes: list[np.ndarray], at_once: int = 100_000) -> np.ndarray:
    """Fingerprints: a bit is 1 if it is set in over half of the text's hashes; no hash, fingerprint zero."""
    out, sizes = np.zeros(len(hashes), np.uint64), np.fromiter(map(len, hashes), np.int64, len(hashes))
    full, begin = np.flatnonzero(sizes), 0
    while begin < len(full):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[full[begin:]]), at_once)))
        rows = full[begin:end]
        flat = np.concatenate([hashes[i] for i in rows])
        sums = np.zeros((len(rows), 64), np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        for lane in range(8):  # bit 8 b + lane of each byte b
            bits = ((flat >> np.uint64(lane)) & np.uint64(0x0101010101010101)).view(np.uint8).reshape(-1, 8)
            sums[:, lane::8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        won = sums * 2 > sizes[rows][:, None]
        out[rows] = np.packbits(won, axis=1, bitorder="little").view("<u8")[:, 0]
        begin = end
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long): the 64 bits as a signed long."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        fp = majority([shingle_hashes(t, width) for t in batch["text"]])
        return {"doc_id": batch["doc_id"], "fp": fp.view(np.int64)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, fp long")


def links(points: DataFrame, radius: int) -> DataFrame:
    """(u, v): a spanning forest of the points (fp, id), distinct in fp, that differ in at most ``radius`` bits."""
    return hamming.in_buckets(points, radius, points.count(), hamming.forest(radius), "u long,v long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints differ in at most ``radius`` bits are linked.

    Texts are read once; from there on only 16 bytes a document move. Equal fingerprints fold into one point (pre-aggregated, so a
    hot group of copies is one row), points meet in buckets and tiles (hamming.py), every bucket returns a spanning forest, and
    components.py joins the forests. Null text counts as empty (fingerprint zero, linked like any other); a null doc_id keeps its
    row, with a null component, and links nothing; rows of one doc_id are one document, so that the fingerprints of its texts are
    linked too. Other columns are ignored; an empty table gives an empty one.
    """
    prints = durable(fingerprints(docs, width))
    points = durable(prints.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("id")))
    edges = links(points, radius)
    several = prints.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("doc_id")
    shared = prints.join(several, "doc_id", "left_semi").join(points, "fp").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    roots = components(edges.unionByName(shared))
    named = points.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``docs`` without those that a document of a smaller id stands for; all columns stay, and all rows without an id."""
    found = near_duplicates(docs, radius, width)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
