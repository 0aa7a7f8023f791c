"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import factoring, fim, isomedia, licenses, mixing, neardup, packing, pii, quality, resampling, sharding, simhash, toxicity
from kmerloom.llm.common import read

#: The tokenizer's file, and the same vocabulary as ranks.
TOKENIZER = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
#: Key of the surrogates; a deployment passes its own.
KEY = "kmerloom-surrogates"
#: The mixing tree: domains of sources, languages, sources. Weights by path; 1 where none is given.
WEB, BOOKS = [f"src{i}" for i in range(6)], [f"src{i}" for i in range(6, 12)]
WEIGHTS = {("web",): 0.5, ("books",): 0.3, ("other",): 0.2, **{(d, lang): w for d in ("web", "books", "other") for lang, w in (("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2))}}


def levels() -> dict:
    source = F.coalesce("source", F.lit(""))
    return {"domain": F.when(source.isin(WEB), "web").when(source.isin(BOOKS), "books").otherwise("other"), "lang": F.col("lang"), "source": F.col("source")}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(read(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_entities")


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(read(spark, sf_dir, "documents"))


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.store(read(spark, sf_dir, "documents"), keep_media=False).drop("media")


def op5_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shards(read(spark, sf_dir, "documents"), 40)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return done.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), levels(), WEIGHTS, 0.6, max_epochs=3)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), "epoch", "tokens")


def op7_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.restore(fim.fill_in_middle(read(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factoring.dedup_substrings(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_pii_surrogates, op3_simhash_fingerprints, op4_iso_media, op5_two_pass_shuffle, op6_hierarchical_mix, op7_bradley_terry_quality, op8_crf_toxicity, op9_bounded_packing, op10_simhash_near_dedup, op11_fill_in_middle, op12_importance_resampling, op13_substring_dedup)}

_DOMAIN = "CASE WHEN source IN ('src0','src1','src2','src3','src4','src5') THEN 'web' WHEN source IN ('src6','src7','src8','src9','src10','src11') THEN 'books' ELSE 'other' END"


def _level(n: int, here: str, parent: str, weight: str, above: str) -> str:
    """One step down the tree: shares of the parent's budget at the spending rate."""
    return f"""
n{n} AS (SELECT {here}, sum(cap)::DOUBLE AS c, {weight} AS w FROM leaf GROUP BY {here}),
r{n} AS (SELECT n.*, {above} AS up, sum(c) OVER (PARTITION BY {parent} ORDER BY c / w, {here} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  sum(w) OVER (PARTITION BY {parent} ORDER BY c / w, {here} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n{n} n{"" if n == 1 else f" JOIN s{n - 1} s USING ({parent})"}),
s{n} AS (SELECT {here}, least(c, max((up - coalesce(before, 0)) / rest) OVER (PARTITION BY {parent}) * w) AS b FROM r{n})"""


_LANG_WEIGHT = "CASE lang WHEN 'en' THEN 0.4::DOUBLE WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.2 ELSE 1 END"
MIX_SQL = f"""
WITH d AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS t, 3 * sum(tokens) AS cap FROM d GROUP BY ALL),
{_level(1, "domain", "1::INT", "CASE domain WHEN 'web' THEN 0.5::DOUBLE WHEN 'books' THEN 0.3 ELSE 0.2 END", "(SELECT least(floor(sum(t) * 0.6::DOUBLE)::DOUBLE, sum(cap)) FROM leaf)")},
{_level(2, "domain, lang", "domain", _LANG_WEIGHT, "s.b")},
{_level(3, "domain, lang, source", "domain, lang", "1::DOUBLE", "s.b")},
share AS (SELECT domain, lang, source, t, floor(b + 0.0005)::BIGINT AS budget, CASE WHEN t > 0 THEN floor(b + 0.0005)::BIGINT // t ELSE 0 END::BIGINT AS whole FROM s3 JOIN leaf USING (domain, lang, source)),
o AS (SELECT d.*, whole, budget - whole * t AS part, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix:' || whole || ':' || doc_id), doc_id) - tokens AS before FROM d JOIN share USING (domain, lang, source))
SELECT doc_id, domain, lang, source, unnest(range(whole + (before < part)::BIGINT))::INT AS epoch, tokens FROM o WHERE whole + (before < part)::BIGINT > 0
"""

#: Tokens cut with RE2, ranks from the same digest; the text rebuilt is the text itself.
FIM_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+') AS tok, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(tok)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(tok[1:a], '') AS head, array_to_string(tok[a + 1:b], '') AS mid, array_to_string(tok[b + 1:n], '') AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

#: Every window spelled out, its smallest document, and the words within reach of a window that an earlier document holds.
SUBSTRING_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
dup AS (SELECT g.doc_id, g.i FROM g JOIN f USING (win) WHERE g.doc_id > f.first),
p AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM w)),
c AS (SELECT p.*, p.p - max(dup.i) OVER (PARTITION BY p.doc_id ORDER BY p.p) AS since FROM p LEFT JOIN dup ON dup.doc_id = p.doc_id AND dup.i = p.p),
s AS (SELECT doc_id, count_if(since < 13)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE since IS NULL OR since >= 13) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op6_hierarchical_mix": MIX_SQL, "op11_fill_in_middle": FIM_SQL, "op13_substring_dedup": SUBSTRING_SQL}
