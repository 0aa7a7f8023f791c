"""SimHash document fingerprints: weighted term hashes vote on signed bits; permuted block tables find near ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kmerloom.llm import hamming
from kmerloom.llm.common import durable, slices

#: Mixes two word hashes to one term hash (odd 64-bit constants: the golden ratio and a Weyl increment).
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def terms(text: str, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes and weights: pairs of neighbouring lower-cased words (a lone word by itself), weight 1 + ln(count)."""
    words = text.lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    h = np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    if len(h) > 1:
        h = h[:-1] * MIX + np.roll(h, -1)[:-1] * STEP
        h ^= h >> np.uint64(29)
        h *= MIX
        h ^= h >> np.uint64(32)
    found, count = np.unique(h, return_counts=True)
    return found, 1 + np.log(count)


def fingerprint(text: str) -> int:
    """64 bits; a bit is 1 where the weighted votes of the text's terms (+ for a set bit, - for a clear one) sum above zero."""
    h, w = terms(text)
    if not len(h):
        return 0
    total = np.zeros(64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += w[i : i + 8192] @ bits
    return int(np.packbits(total * 2 > w.sum() + 1e-9, bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    """Estimate of the cosine of two weighted term vectors from their fingerprints, cut at 0: 1 for equal ones."""
    return max(0.0, float(np.cos(np.pi * (a ^ b).bit_count() / 64)))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long, head boolean, text string"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compared(doc_id: int | None, text: str, fp: int, following: str, following_fp: int) -> dict:
    new = edited(text, following)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fp": _signed(fp), "edited_fp": _signed(fp if new == text else fingerprint(new)), "next_fp": _signed(following_fp), "head": False, "text": None}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks one range of doc_ids in order. A range's first text also leaves as a head, its last one unfinished, with its text."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    last: tuple | None = None
    for batch in chain.from_iterable(map(slices, batches)):
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fp = fingerprint(text)
            if last is None:
                out.append({n: None for n in names} | {"doc_id": doc_id, "fp": _signed(fp), "head": True, "text": text})
            else:
                out.append(_compared(*last, text, fp))
            last = (doc_id, text, fp)
        yield batch_of(out)
    if last is not None:
        yield batch_of([{n: None for n in names} | {"doc_id": last[0], "n_chars": len(last[1]), "fp": _signed(last[2]), "head": False, "text": last[1]}])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        done = [_compared(r["doc_id"], r["text"], r["fp"] % (1 << 64), r["head_text"], r["head_fp"] % (1 << 64)) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string() if k == "edited_sha256" else pa.int64()) for k in ("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")], names=["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp), each document beside the next one by doc_id (the last beside the first).

    One range shuffle of the texts; ranges are walked as streams. Only each range's first and last text meet across ranges, in a
    table of two rows a range. Null texts count as empty, null ids come first; rows of one id are ordered by text.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = durable(ordered.mapInArrow(_run, SCHEMA).withColumn("range", F.spark_partition_id()))
    heads = found.filter("head").select("range", "doc_id", F.col("text").alias("head_text"), F.col("fp").alias("head_fp"))
    ends = found.filter("not head and text is not null")
    # the next range that holds rows is found on range numbers, which follow doc_id order
    numbers = heads.select("range")
    following = numbers.withColumn("follows", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy(F.lit(0)))))
    closing = ends.select("range", "doc_id", "n_chars", "fp", "text").join(following, "range").join(heads.select(F.col("range").alias("follows"), "head_text", "head_fp"), "follows")
    closed = closing.select("doc_id", "text", "fp", "head_text", "head_fp").mapInArrow(_finish, "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long")
    inner = found.filter("not head and text is null").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
    return inner.unionByName(closed)


def near_counts(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, n_near): for every distinct fingerprint of ``prints(fp)`` how many others lie within the radius, by permuted block tables."""
    points = durable(prints.select("fp").distinct().withColumn("id", F.col("fp")))
    n = points.count()
    near = hamming.in_buckets(points, radius, n, hamming.counts(radius, n), "id long,m long")
    return points.join(near.groupBy("id").agg(F.sum("m").alias("m")), "id", "left").select("fp", F.coalesce("m", F.lit(0)).alias("n_near"))


def fingerprint_report(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints, edited fingerprints, likenesses, and the number of other fingerprints within ``radius`` bits."""
    found = durable(with_next(docs))
    near = near_counts(found, radius)
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    alike = lambda a, b: F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(F.lit(np.pi) * F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64)))
    return found.join(near, "fp", "left").select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), alike("fp", "edited_fp").alias("near_edited"), alike("fp", "next_fp").alias("near_next"), "n_near")
