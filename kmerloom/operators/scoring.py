"""Scores of assignments against the truth, mixtures of known make-up, and model features."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.kmers import six


def strain_counts(classified: DataFrame) -> DataFrame:
    """(ref_id, n): reads a reference, failed reads left out."""
    return classified.filter(~(F.col("fail_depth") | F.col("fail_matches") | F.col("fail_diff"))).groupBy("ref_id").agg(F.count("*").alias("n"))


def confusion(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """(tp, fp, tn, fn) where a score of 0 or more says yes."""
    yes, true = F.col(score) >= 0, F.col(truth) == 1
    return scored.agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & ~true).alias("tn"), F.count_if(~yes & true).alias("fn"))


def verdict(score: Column) -> Column:
    """A binary model's prediction in words."""
    return F.when(score > 0, "COINF").when(score < 0, "PURE").otherwise("UNKNOWN")


def accuracy_by_group(assigned: DataFrame, group: str, estimate: str, truth: str) -> DataFrame:
    """(group, n, pct_correct)."""
    return assigned.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col(estimate) == F.col(truth)).cast("double")).alias("pct_correct"))


def accuracy_of_lineages(calls: DataFrame, least_sim: float = 0.0) -> DataFrame:
    """(strain, n, pct_sublineage, pct_lineage) of ``calls(strain, lineage, lin_sim, sublineage, sub_sim)``: a call is right when it names the strain (the lineage: its first letter) with a similarity over ``least_sim``."""
    sub = (F.col("strain") == F.col("sublineage")) & (F.col("sub_sim") > least_sim)
    lin = (F.substring("strain", 1, 1) == F.substring("lineage", 1, 1)) & (F.col("lin_sim") > least_sim)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return calls.groupBy("strain").agg(F.count("*").alias("n"), share(sub).alias("pct_sublineage"), share(lin).alias("pct_lineage"))


def composition(calls: DataFrame, least_sim: float = 0.01) -> DataFrame:
    """(name, n, pct): estimated make-up by the sub-lineages called with a similarity over ``least_sim``."""
    counted = calls.filter(F.col("sub_sim") > least_sim).groupBy(F.col("sublineage").alias("name")).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def total_error(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """One row from (name, pct) tables: the summed absolute error, whether first and second agree or are flipped, and what the truth over 0.05 and 0.1 says of it."""
    both = truth.select("name", F.col("pct").alias("t")).join(estimate.select("name", F.col("pct").alias("e")), "name", "full").fillna(0.0, ["t", "e"])
    for side in "te":
        both = both.withColumn(f"r{side}", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(side), "name")))
    named = lambda side, rank: F.max(F.when(F.col(f"r{side}") == rank, F.col("name")))
    return both.agg(
        F.sum(F.abs(F.col("t") - F.col("e"))).alias("total_error"), (named("t", 1) == named("e", 1)).alias("primary_found"), (named("t", 2) == named("e", 2)).alias("secondary_found"),
        ((named("t", 1) == named("e", 2)) & (named("t", 2) == named("e", 1))).alias("flipped"), F.count_if((F.col("t") > 0.05) & (F.col("e") > 0.05)).alias("found_005"), F.count_if((F.col("t") > 0.1) & (F.col("e") > 0.1)).alias("found_01"),
    )


def reads_needed(coverage: float, length: int, share: float, read_length: int = 250) -> int:
    return math.ceil(coverage * (length / read_length) * share)


def mixture_sample(reads: DataFrame, group: str, wanted: dict[str, int] | Column, seed: int = 42) -> DataFrame:
    """A fixed number of reads of each group, first by a seeded hash of their ids (ties by id). The seed makes the choice repeatable.

    Only each group's first reads by the hash are kept while sorting (Spark limits a window's group by the rank filter).
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    n = wanted if isinstance(wanted, Column) else reduce(lambda c, kv: F.when(F.col(group) == kv[0], F.lit(kv[1])).otherwise(c), wanted.items(), F.lit(0))
    return reads.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, "id"))).filter(F.col("_r") <= n).drop("_r")


def mixture_reads(reads: DataFrame, spec: list[tuple[int, str, float, int]], genome_length: float, strain: str = "strain", seed: int = 42, read_length: int = 250) -> DataFrame:
    """``reads(id, strain, ...)`` drawn for every mixture of ``spec`` (mixture, strain, proportion, coverage), with ``mixture`` and ``mixture_name``.

    A strain gives ceil(coverage * genome / read length * proportion) reads, first by a seeded hash of their ids; every mixture is the union of its strains'.
    """
    names = {m: "_".join(f"{s}-{p:g}" for x, s, p, _ in spec if x == m) + "_" + str([c for x, _, _, c in spec if x == m][-1]) for m in {row[0] for row in spec}}
    rows = [(m, names[m], s, reads_needed(c, genome_length, p, read_length)) for m, s, p, c in spec]
    wanted = reads.sparkSession.createDataFrame(rows, f"mixture int, mixture_name string, {strain} string, _n long")  # as long as the design
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    drawn = reads.join(F.broadcast(wanted), strain).withColumn("_r", F.row_number().over(Window.partitionBy("mixture", strain).orderBy(order, "id")))
    return drawn.filter(F.col("_r") <= F.col("_n")).drop("_r", "_n")


def shuffled(rows: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """``rows`` in a seeded random order (by ``shuffle_key``, a hash of the key), as a distributed sort."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("shuffle_key", mixed).orderBy("shuffle_key", key)


def strain_features(found: DataFrame, strains: list[str] | None = None, collapse: bool = False) -> DataFrame:
    """(sample, strain, n) of ``found(sample, strain)``: reads a strain. A missing name counts as 'unclassified'; ``collapse`` keeps first letters ('U'); every strain of ``strains`` is there, with 0 if need be."""
    blank = F.col("strain").isNull() | (F.col("strain") == "")
    name = F.when(blank, "U" if collapse else "unclassified").otherwise(F.substring("strain", 1, 1) if collapse else F.col("strain"))
    counted = found.groupBy("sample", name.alias("strain")).agg(F.count("*").alias("n"))
    if strains:
        zero = found.select("sample").distinct().select("sample", F.explode(F.array(*map(F.lit, strains))).alias("strain"), F.lit(0).cast("long").alias("n"))
        counted = counted.unionByName(zero).groupBy("sample", "strain").agg(F.sum("n").alias("n"))
    return counted


def sample_labels(samples: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(sample, label) of ``samples(sample, coinfected)``: 1 or -1, or with ``classes(name, label)`` the class of 'coinfected' or of the sample's first letter."""
    if classes is None:
        return samples.select("sample", F.when(F.col("coinfected"), "1").otherwise("-1").alias("label"))
    name = F.when(F.col("coinfected"), "coinfected").otherwise(F.substring("sample", 1, 1))
    known = F.broadcast(classes.select(F.col("name").alias("_name"), F.col("label").cast("string").alias("label")))  # one row a class of a label map
    return samples.withColumn("_name", name).join(known, "_name").select("sample", "label")


def result_lines(features: DataFrame, labels: DataFrame, tag: str = "hpv", namespace: str = "vir", normalize: bool = False) -> DataFrame:
    """(sample, line): one model line a sample, "label 1.0 'tag |namespace strain:count ...", strains by name; ``normalize`` gives shares."""
    listed = features.groupBy("sample").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("strain", "n"))).alias("l")).join(labels, "sample")
    weight = (lambda x: six(x["n"] / F.col("total"))) if normalize else (lambda x: x["n"].cast("string"))
    pairs = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["strain"], weight(x))), " ")
    return listed.select("sample", F.concat("label", F.lit(f" 1.0 '{tag} |{namespace} "), pairs).alias("line"))


def random_mixtures(strains: list[str], n: int, seed: int, least: float = 0.04, most: float = 0.5, coverage: tuple[int, int] = (20, 200), largest: int = 5) -> list[list[tuple[str, float, int]]]:
    """n mixture designs as (strain, proportion, coverage): two to ``largest`` strains, drawn proportions within bounds, the first takes the rest."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        names = rng.sample(strains, rng.randint(2, min(largest, len(strains))))
        deep = rng.randint(*coverage)
        minor: list[float] = []
        while not minor or sum(minor) > 1 - least:
            minor = [round(rng.uniform(least, most), 3) for _ in names[1:]]
        out.append([(s, round(p, 3), deep) for s, p in zip(names, [1 - sum(minor), *minor])])
    return out


def feature_line(label: Column, tag: Column, namespace: str, weights: Column) -> Column:
    """'label 1.0 `tag|namespace name:weight ...' of map<string, number>; bars in the tag become underscores."""
    pairs = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return F.concat(label.cast("string"), F.lit(" 1.0 `"), F.translate(tag, "|", "_"), F.lit(f"|{namespace} "), F.array_join(pairs, " "))


def lineage_model(train: DataFrame, test: DataFrame, features: str, label: str, buckets: int = 4096, rounds: int = 50) -> DataFrame:
    """``test`` with ``prediction`` by logistic regression on hashed features (array<string>)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    tf = HashingTF(inputCol=features, outputCol="_x", numFeatures=buckets)
    model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=rounds, regParam=0.01).fit(tf.transform(train))
    return model.transform(tf.transform(test)).drop("_x", "rawPrediction", "probability")
