"""Importance resampling towards a target corpus, by hashed word runs.

Method: inverted postings, partitioned by bucket. Every document's (bucket, count) postings go to the tasks of their bucket ranges, where
the totals of both corpora give each bucket's gain; the tasks emit contributions, which are summed by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kmerloom.llm.common import arrow_map, durable

#: Bucket ranges. A document has a posting row in each range it touches.
RANGES = 16
#: Features of a range's task, about; a range of more is dealt to several tasks by document.
TASK = 1 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on UTF-8 bytes: those of letters beyond ASCII are all above 7F
POSTINGS = "range int, doc_id long, key long, copies long, n_words long, steps binary, counts binary"


def features(text: str | None, buckets: int, longest: int = 3) -> tuple[int, np.ndarray]:
    """(words, bucket of every run of one to ``longest`` words): A-Z lower-cased, runs joined by a space. A run's checksum goes on from that of the run without its last word."""
    words = WORD.findall((text or "").encode().lower())
    spaced, run, out = [b" " + w for w in words], list(map(crc32, words)), []
    for n in range(1, longest + 1):
        out.append(np.fromiter(run, np.int64, len(run)) % buckets)
        run = list(map(crc32, spaced[n:], run))
    return len(words), np.concatenate(out)


def counted(found: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count), ascending."""
    if 8 * len(found) < buckets:
        return np.unique(found, return_counts=True)
    counts = np.bincount(found, minlength=buckets)
    return (values := np.flatnonzero(counts)), counts[values]


def packed(values: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(range, steps, counts) of a document's ascending buckets: a byte for the step from the bucket before and one for the count. A wider step is
    made up of steps of 255 with count 0, a larger count of steps of 0."""
    own = np.searchsorted(edges, values, "right") - 1
    first = np.diff(own, prepend=-1) > 0
    steps = np.where(first, values - edges[own] + 1, np.diff(values, prepend=0))
    fill, more = (steps - 1) // 255, (counts - 1) // 255
    if fill.any() or more.any():
        each = 1 + fill + more
        at = np.repeat(np.arange(len(each)), each)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each) - fill[at]
        steps, counts, own = np.where(turn < 0, 255, np.where(turn == 0, (steps - 255 * fill)[at], 0)), np.where(turn < 0, 0, np.where(turn == 0, (counts - 255 * more)[at], 255)), own[at]
    cuts = np.searchsorted(own, np.arange(len(edges)))
    steps, counts = steps.astype(np.uint8).tobytes(), counts.astype(np.uint8).tobytes()
    return [(r, steps[a:b], counts[a:b]) for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b or r == 0]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, length of each value) of a binary column, nulls as empty."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(offsets) else np.zeros(0, np.uint8), np.diff(offsets)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place within its range, count) of all postings of a batch."""
    steps, sizes = _bytes_of(batch["steps"])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    return rows, sums[1:] - sums[np.cumsum(sizes) - sizes][rows] - 1, _bytes_of(batch["counts"])[0].astype(np.int64)


def postings(docs: DataFrame, buckets: int) -> DataFrame:
    """(range, doc_id, key, copies, n_words, steps, counts): a document's packed postings of each range of buckets; range 0 always has a row. ``key`` is the
    text's hash; rows of one id and text that meet in a slice are one with ``copies``."""
    edges = np.array([-(-r * buckets // RANGES) for r in range(RANGES + 1)])

    def rows(batch: dict[str, list]) -> dict[str, list]:
        same: dict[tuple, int] = {}
        for doc in zip(batch["doc_id"], batch["text"]):
            same[doc] = same.get(doc, 0) + 1
        out: list[tuple] = []
        for (doc_id, text), copies in same.items():
            n, found = features(text, buckets)
            key = int(np.uint64(xxh64_intdigest((text or "").encode())).view(np.int64))
            out += [(r, doc_id, key, copies, n, steps, counts) for r, steps, counts in packed(*counted(found, buckets), edges)]
        return dict(zip((f.split()[0] for f in POSTINGS.split(", ")), map(list, zip(*out)))) if out else {f.split()[0]: [] for f in POSTINGS.split(", ")}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, POSTINGS)


def totals(found: DataFrame, buckets: int) -> DataFrame:
    """(range, sums): features in each bucket of each range, folded in every task before the shuffle (``buckets`` numbers a task)."""
    width = -(-buckets // RANGES)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(RANGES * width, np.int64)
        for batch in batches:
            rows, places, counts = unpacked(batch)
            own, copies = batch["range"].to_numpy().astype(np.int64), batch["copies"].to_numpy()
            sums += np.bincount(own[rows] * width + places, counts * copies[rows], RANGES * width).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"range": pa.array(range(RANGES), pa.int32()), "sums": pa.array(sums.reshape(RANGES, width).tolist(), pa.list_(pa.int64()))})

    parts = found.select("range", "copies", "steps", "counts").mapInArrow(fold, "range int, sums array<long>")
    each = parts.select("range", F.posexplode("sums").alias("place", "n")).groupBy("range", "place").agg(F.sum("n").alias("n"))
    listed = each.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("l"))  # ``width`` entries each
    return listed.select("range", F.transform("l", lambda x: x["n"]).alias("sums"))


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket, in doubles."""
    s, t = s.astype(float), t.astype(float)
    return np.floor(1000 * np.log((t + 1) * float(all_s + buckets) / ((s + 1) * float(all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the summed gains of its features.

    The postings are written once. A range's totals of both corpora are sent to each of its tasks and sorted before its postings, so that
    a task holds one range's gains and passes its postings by, whatever their number; a contribution is one number a document and range.
    """
    found = durable(postings(docs, buckets))
    ours = durable(totals(found, buckets).withColumnRenamed("sums", "s"))
    theirs = totals(postings(target, buckets), buckets).withColumnRenamed("sums", "t")
    zeros = F.transform("s", lambda n: F.lit(0).cast("long"))
    both = durable(ours.join(theirs, "range", "left").select("range", "s", F.coalesce("t", zeros).alias("t")))
    plus = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    all_s, all_t = (n or 0 for n in both.agg(F.sum(plus(F.col("s"))), F.sum(plus(F.col("t")))).first())
    deals = max(1, all_s // (RANGES * TASK))
    none = F.lit(None)
    first = both.select("range", F.explode(F.sequence(F.lit(0), F.lit(deals - 1).cast("int"))).alias("deal"), F.lit(0).alias("turn"), "s", "t", *(none.cast(k).alias(c) for c, k in (("doc_id", "long"), ("key", "long"), ("copies", "long"), ("n_words", "long"), ("steps", "binary"), ("counts", "binary"))))
    lists = (none.cast("array<long>").alias(c) for c in "st")
    then = found.select("range", F.pmod(F.xxhash64("doc_id", "key"), F.lit(deals)).cast("int").alias("deal"), F.lit(1).alias("turn"), *lists, "doc_id", "key", "copies", "n_words", "steps", "counts")

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros(0, np.int64)
        for batch in batches:
            rows, places, counts = unpacked(batch)
            part = np.zeros(batch.num_rows, np.int64)
            turns = np.flatnonzero(batch["turn"].to_numpy() == 0)
            for a, b in zip(np.append(0, turns), np.append(turns, batch.num_rows)):
                own = slice(*np.searchsorted(rows, [a, b]))  # from one range's totals to the next
                part[a:b] += np.bincount(rows[own] - a, gain[places[own]] * counts[own], b - a).astype(np.int64) if a < b and own.start < own.stop else 0
                if b < batch.num_rows:
                    gain = gains(*(np.array(batch[c][int(b)].as_py()) for c in "st"), all_s, all_t, buckets)
            copies = np.nan_to_num(batch["copies"].to_numpy(zero_copy_only=False)).astype(np.int64)
            ones = np.where(batch["range"].to_numpy() == 0, copies, 0)
            made = {"doc_id": batch["doc_id"], "key": batch["key"], "n_words": batch["n_words"], "part": pa.array(part * copies), "copies": pa.array(ones)}
            yield pa.RecordBatch.from_pydict(made).filter(pc.equal(batch["turn"], 1))

    dealt = first.unionByName(then).repartition("range", "deal").sortWithinPartitions("range", "deal", "turn")
    parts = dealt.mapInArrow(contributions, "doc_id long, key long, n_words long, part long, copies long")
    summed = parts.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.sum("part").alias("part"), F.sum("copies").alias("copies"))
    n = F.col("n_words")
    runs = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return summed.select("doc_id", "n_words", runs.alias("n_features"), F.expr("part div copies").alias("weight"), each.alias("_copy")).drop("_copy")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored(doc_id, score, eligible, ...)`` with ``rank`` of the ``drawn`` highest eligible scores, ties to the smaller id. Rows are ranged by score, so that
    each task ranks its own range behind the counted rows of those before it; no task sees all."""
    best = scored.filter("eligible").select("*", F.lit(None).cast("long").alias("rank"))
    placed = durable(best.drop("rank").repartitionByRange(F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number a task
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    starts = [s for s in starts if s[1] < drawn]
    if not starts:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    begins = F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, begin long"))
    run = Window.partitionBy("part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    at = placed.join(begins, "part", "left").withColumn("at", F.col("begin") + F.row_number().over(run))
    kept = at.withColumn("rank", F.when(F.col("at") <= drawn, F.col("at"))).select(*best.columns)
    return kept.unionByName(scored.filter("NOT eligible").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = 10_000, seed: str = "42") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): of the documents with ``least_words`` words or more the ``share`` (a fraction, rounded down) of the highest
    scores is drawn without replacement: weight plus seeded Gumbel noise of the id, in thousandths.

    Null texts hold no feature; a null id draws its noise as an id without digits and loses ties; rows of one id are documents of their own with the same noise; an empty target or
    table is fine; other columns are ignored.
    """
    found = durable(weights(docs, target, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    scored = found.withColumns({"score": F.col("weight") + gumbel, "eligible": F.col("n_words") >= least_words})
    drawn = scored.filter("eligible").count() * share[0] // share[1]
    return ranked(scored, drawn).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
