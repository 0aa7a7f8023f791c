"""What the operators of this subpackage share: reading, Arrow maps, durable cuts, models fitted on labelled samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.cluster import durable, spread  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; one that sits in fewer splits than there are cores is dealt out evenly."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Python work takes an Arrow batch in slices of about this size, so that what it makes of one slice is gone before the next.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in row slices of about SLICE_BYTES, one row at least."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of batches as column lists; ``rows`` is called for each slice on its own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = rows(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fitted[Model](docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int, seed: str, learn: Callable[[list[tuple[str, int]]], Model]) -> Model:
    """What ``learn`` makes of at most ``limit`` (text, label) pairs from rows whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``.

    Which labelled ids are taken is settled on the narrow label table by a seeded hash; their texts are then read with
    an id filter. Rows without id or label are left out; where one id has several labels the largest holds; where one id has several
    texts the smallest counts. The bounded sample is learned from in one task, in order of the ids, so the driver holds the model alone and
    a lost executor's task begins again.
    """
    key = F.col("doc_id").cast("string")
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(key) % modulus != held_out))
        .groupBy("doc_id").agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)
    )
    wanted = {r.doc_id: int(r.y) for r in ids.collect()}
    if not wanted:
        return learn([])
    small = docs.sparkSession.createDataFrame(list(wanted.items()), "doc_id long, y int")
    texts = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(learn([(text, y) for _, text, y in rows]))]})

    made = texts.select("doc_id", "text", "y").coalesce(1).mapInArrow(model, "model binary").collect()
    return pickle.loads(made[0].model) if made else learn([])
