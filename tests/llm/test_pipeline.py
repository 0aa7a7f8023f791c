from collections import Counter

import corpus_pipeline as P
from kmerloom.llm import mixing, pii, queries, toxicity
from tests.llm.data import odd
from tests.llm.test_likeness import kept

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage does to its predecessor's rows what its operator says, and run() returns the last one's rows."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    after = {"documents": docs}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = after[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == before.columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in after.items()}
    assert ids["toxicity"] == {r.doc_id for r in toxicity.toxicity(after["documents"], labels).filter("predicted = 0").collect()}
    assert ids["near_dedup"] == kept([(r.doc_id, r.text) for r in after["toxicity"].collect()]) and not ids["near_dedup"] & {145, 177}, "near copies by five-word Jaccard, those beyond 3 of 64 bits too"
    assert ids["pii"] == ids["near_dedup"] and after["pii"].exceptAll(pii.replace_pii(after["near_dedup"], queries.KEY).select(*P.COLUMNS)).count() == 0
    assert ids["mixing"] == {r.doc_id for r in mixing.mix(after["pii"], queries.levels(), queries.WEIGHTS, 0.9).collect()} and len(ids["mixing"]) < len(ids["pii"])
    assert ids["packing"] == ids["mixing"]
    rows = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(P.run(spark, D)) == rows(after["packing"])


def test_odd_rows(spark):
    docs = odd(spark, clashes=False)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, D).checkpoint()
    assert docs.count() > 20
