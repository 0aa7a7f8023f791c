"""Two-pass external shuffle into shards: scatter to memory-sized buckets by a seeded hash, Fisher-Yates in each bucket."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructType

from kmerloom.llm.common import durable, slices

#: Buckets there are at least, so that a small table is shuffled by more than one task; tasks of pass two there are at most (each walks its buckets one by one).
LEAST_BUCKETS, MOST_TASKS = 64, 20_000
#: Equal rows of more than this part of a bucket are dealt one by one.
HEAVY = 16
#: Copies expanded by one task.
COPIES = 100_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1: from the end, each place swaps with a place at or before it."""
    order = np.arange(n)
    picks = rng.integers(0, np.arange(1, n + 1)) if n else []
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def _permuted(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Walks a stream sorted by bucket; each bucket is gathered, shuffled and let go with its rows' places."""

    def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        order = fisher_yates(table.num_rows, np.random.default_rng([seed, table["bucket"][0].as_py()]))
        at = 0
        for batch in table.to_batches():
            for part in slices(batch):  # taken slice by slice, so that there is no second copy of the bucket
                here = pa.array(order[at : at + part.num_rows])
                taken = table.take(here).combine_chunks()
                place = pa.array(np.arange(at, at + part.num_rows))
                yield from taken.append_column("place", place).to_batches()
                at += part.num_rows

    held: list[pa.RecordBatch] = []
    for batch in batches:
        buckets = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
        begin = 0
        for end in [*(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]:
            part = batch.slice(begin, end - begin)
            if held and len(buckets) and held[0].column(part.schema.get_field_index("bucket"))[0] != part.column(part.schema.get_field_index("bucket"))[0]:
                yield from out(held)
                held = []
            held += [part] * bool(part.num_rows)
            begin = end
    if held:
        yield from out(held)


def _mixed(key: Column, copy: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, copy.cast("long")), F.lit(buckets))


def shuffle_rows(docs: DataFrame, seed: int = 1, bucket_bytes: int = 32 << 20) -> DataFrame:
    """(row struct, size, position): every row of ``docs`` with its place in a seeded uniform order, 0 to n-1 without gaps, as runs of
    positions by task: each task's rows come out in order.

    Pass 1 scatters rows by a seeded hash of all their columns into buckets of about ``bucket_bytes``; pass 2 reads each bucket in a
    fixed order, shuffles it in memory and numbers it from the bucket's start. The order depends on rows, seed and bucket
    size alone, so a lost task gives the same rows again on any cluster. Texts are shuffled once. Equal rows share a hash; where they would
    fill more than a ``HEAVY``-th of a bucket they are folded into one row with a count before the shuffle and dealt out again by copy
    number, so a third of all rows being equal fills no bucket.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    plain = [F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in docs.schema.fields]
    rows = docs.select(F.struct(*docs.columns).alias("row"), size.alias("size"), F.xxhash64(F.lit(seed), *plain).alias("key"))
    found = durable(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    total = found.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(-(-total // bucket_bytes), LEAST_BUCKETS)
    # so few keys are heavy: their bytes are at least a HEAVY-th of a bucket each
    heavy = F.col("bytes") > F.lit(max(1, bucket_bytes // HEAVY))
    hot = found.filter((F.col("n") > 1) & heavy).select("key")
    cold = found.filter(~((F.col("n") > 1) & heavy))
    counts = [cold.select(_mixed(F.col("key"), F.lit(0), buckets).alias("bucket"), "n")]
    dealt = rows
    if hot.limit(1).count():
        near = F.broadcast if HEAVY * buckets <= 1 << 22 else lambda df: df
        folded = durable(rows.join(near(hot), "key", "left_semi").groupBy("row", "size", "key").agg(F.count("*").alias("n")))
        parts = folded.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES))).alias("first")).repartition("key", "first")
        copies = parts.select("row", "size", "key", F.explode(F.sequence("first", F.least(F.col("n") - 1, F.col("first") + (COPIES - 1)))).alias("copy"))
        counts.append(copies.select(_mixed(F.col("key"), F.col("copy"), buckets).alias("bucket"), F.lit(1).cast("long").alias("n")))
        dealt = rows.join(near(hot), "key", "left_anti").select("row", "size", "key", F.lit(0).cast("long").alias("copy")).unionByName(copies)
        dealt = dealt.withColumn("bucket", _mixed(F.col("key"), F.col("copy"), buckets))
    else:
        dealt = rows.withColumns({"copy": F.lit(0).cast("long"), "bucket": _mixed(F.col("key"), F.lit(0), buckets)})
    numbers = reduce(DataFrame.unionByName, counts).groupBy("bucket").agg(F.sum("n").alias("n"))
    starts = numbers.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    tasks = min(buckets, MOST_TASKS)
    dealt = dealt.repartitionById(tasks, F.floor(F.col("bucket") * tasks / buckets).cast("int"))
    fixed = dealt.sortWithinPartitions("bucket", "key", "copy", "row.doc_id", "row.text").select("row", "size", "bucket")
    schema = StructType([*fixed.schema.fields]).add("place", LongType())
    placed = fixed.mapInArrow(lambda batches: _permuted(batches, seed), schema)
    starts = F.broadcast(starts) if buckets <= 1 << 20 else starts  # one row a bucket
    return placed.join(starts, "bucket").select("row", "size", (F.col("start") + F.col("place")).alias("position"))


def shards(docs: DataFrame, n: int = 40, seed: int = 1, bucket_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus 16), ``shard`` and ``slot``: shard s holds the positions from floor(s total / n) on, so counts differ by one at most
    and a shard is a run of buckets.

    Null texts count as empty; null and repeated ids keep their rows; an empty table gives an empty one. Columns of these names in
    ``docs`` are replaced, all others stay.
    """
    docs = docs.drop("size", "shard", "slot")
    total = max(1, docs.count())
    done = shuffle_rows(docs, seed, bucket_bytes).withColumn("_shard", F.expr(f"((position + 1) * {n} - 1) div {total}"))  # whole numbers throughout
    return done.select("row.*", "size", F.col("_shard").cast("int").alias("shard"), (F.col("position") - F.expr(f"_shard * {total} div {n}")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, written by pass two's own tasks without another shuffle: a file holds a range of slots in order, and a
    task's buckets touch a few neighbouring shards only."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
