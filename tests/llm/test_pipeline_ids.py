import zlib

import numpy as np

import corpus_pipeline as P

D = "/root/testdata/sf0.001"


def test_last_stage_holds_its_tokens(spark):
    """Every piece has its ids, and they are those of its length and checksum."""
    got = P.packing_stage(spark, spark.read.parquet(f"{D}/documents.parquet"), D).collect()
    assert got and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
