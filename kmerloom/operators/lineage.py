"""Group-specific k-mers, lineage assignment, and what is told from assignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.arrays import NAMES
from kmerloom.functions.kmers import six
from kmerloom.operators import buckets, stretches
from kmerloom.operators.sketch import durable, hash_table

#: Group names up to this number are broadcast.
GROUPS = 100_000
#: Hashes that are asked for up to this number travel with every task.
AMONG = 4_000_000


def lineage_of(name: Column, letters: int) -> Column:
    """Panels name a lineage by the first character, a sub-lineage by the first two."""
    return F.substring(name, 1, letters)


def group_unique(seqs: DataFrame, group: str, ks: int | list[int], among: DataFrame | None = None, **how) -> DataFrame:
    """(group, hash) of hashes that occur in one group only; with ``among(hash)`` those of its hashes (counted: beyond ``AMONG`` it is met by a join).

    A hash is unique when its smallest and largest group agree. Hashes are folded as arrays in buckets (operators/buckets.py, stretches.py), where they can be made so. Groups travel as a long each, and get their names back at the end.
    """
    ks = [ks] if isinstance(ks, int) else ks
    named = seqs.select(F.col(group).alias("g"), F.xxhash64(group).alias("code"), F.col("seq"))
    few = None
    if among is not None:
        among = durable(among.select("hash").distinct())
        few = among if among.count() <= AMONG else None
    if how.get("name", "md5") in NAMES:
        ends = stretches.unique(named, ks[0], **how) if few is None and len(ks) == 1 and ks[0] >= stretches.LEAST else buckets.unique(named, ks, few, **how)
    else:
        table = hash_table(named.select(F.col("code").alias("id"), "seq"), ks, **how)
        ends = table.groupBy("hash").agg(F.min("id").alias("code"), F.max("id").alias("last")).filter(F.col("code") == F.col("last"))
    ends = ends if among is None else ends.join(among, "hash", "left_semi")
    names = durable(named.filter(F.col("g").isNotNull()).select("g", "code").distinct())
    names = F.broadcast(names) if names.count() <= GROUPS else names
    return ends.join(names, "code").select(F.col("g").alias(group), "hash")


def group_overlap(reads: DataFrame, ks: list[int], unique: DataFrame, group: str, similarity: str = "read", deep: DataFrame | None = None, **how) -> DataFrame:
    """(read_id, group, shared, n_hashes, sim, rank): distinct hashes that a read shares with each group's own ones, ranked.

    ``n_hashes`` counts all of the read's k-mers, repeated and masked ones too; with ``deep(hash)`` only those hashes can be shared.
    Similarity is shared over these (``read``), over the group's hashes (``group``) or over the union (``jaccard``); ranks fall with it, ties by group name.
    """
    table = hash_table(reads, ks, **how)
    n = read_sizes(reads, ks)
    held = table.select("id", "hash").distinct()
    held = held if deep is None else held.join(deep, "hash", "left_semi")
    shared = held.join(unique, "hash").groupBy("id", group).agg(F.count("*").alias("shared"))
    if similarity == "read":
        return ranked(shared, n, group)
    out = shared.join(n, "id")
    if similarity != "read":  # a group's own hashes count
        out = out.join(unique.groupBy(group).agg(F.count("*").alias("size")), group)
    total = {"read": F.col("n_hashes"), "group": F.col("size") if similarity != "read" else None, "jaccard": F.col("n_hashes") + F.col("size") - F.col("shared") if similarity != "read" else None}[similarity]
    out = out.withColumn("sim", F.col("shared") / total)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), group))
    return out.withColumn("rank", rank).select(F.col("id").alias("read_id"), group, "shared", "n_hashes", "sim", "rank")


def ranked(shared: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """``group_overlap``'s table of (id, group, shared) and (id, n_hashes)."""
    out = shared.join(sizes, "id").withColumn("sim", F.col("shared") / F.col("n_hashes"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), group))
    return out.withColumn("rank", rank).select(F.col("id").alias("read_id"), group, "shared", "n_hashes", "sim", "rank")


def read_sizes(reads: DataFrame, ks: list[int]) -> DataFrame:
    """(id, n_hashes): number of k-mers, by length alone."""
    n = reduce(Column.__add__, (F.greatest(F.lit(0), F.coalesce(F.length("seq"), F.lit(0)) - (k - 1)) for k in ks))
    return reads.groupBy("id").agg(F.sum(n.cast("long")).alias("n_hashes"))


def ranked_lists(overlap: DataFrame, group: str) -> DataFrame:
    """(read_id, n_hashes, groups): array<struct<name, sim, shared>> in rank order."""
    one = F.struct("rank", F.col(group).alias("name"), "sim", "shared")
    listed = overlap.groupBy("read_id").agg(F.max("n_hashes").alias("n_hashes"), F.sort_array(F.collect_list(one)).alias("l"))
    return listed.select("read_id", "n_hashes", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["sim"].alias("sim"), x["shared"].alias("shared"))).alias("groups"))


def first_qualifying(groups: Column, least_shared: int, least_sim: float = 0.0) -> Column:
    """Name of the first group with more shared hashes and a higher similarity than given; null without one."""
    good = F.filter(groups, lambda g: (g["shared"] > least_shared) & (g["sim"] > least_sim))
    return F.try_element_at(good, F.lit(1))["name"]


def assign(reads: DataFrame, min_hashes: int = 50, min_type_match: int = 15) -> DataFrame:
    """Lineage and sub-lineage of ``reads(read_id, n_hashes, type_shared, lin, sublin)``, whose lists are ranked.

    Reads with fewer hashes or type matches go. The lineage is the first with more than 5 shared hashes, the sub-lineage the first
    with more than 2 and a similarity over 0.005. Where both are there and disagree, a strong lineage (more than 10) takes the second sub-lineage if that one
    agrees and has more than 2; else the sub-lineage is cleared.
    """
    kept = reads.filter((F.col("n_hashes") >= min_hashes) & (F.col("type_shared") >= min_type_match))
    lin, sub = first_qualifying(F.col("lin"), 5), first_qualifying(F.col("sublin"), 2, 0.005)
    kept = kept.withColumns({"lineage": F.coalesce(lin, F.lit("")), "sublineage": F.coalesce(sub, F.lit(""))})
    second = F.try_element_at("sublin", F.lit(2))
    agrees = (F.try_element_at("lin", F.lit(1))["shared"] > 10) & (second["shared"] > 2) & (F.substring(second["name"], 1, 1) == F.try_element_at("lin", F.lit(1))["name"])
    differs = (F.col("lineage") != "") & (F.col("sublineage") != "") & (F.substring("sublineage", 1, 1) != F.col("lineage"))
    return kept.withColumn("sublineage", F.when(differs, F.when(F.coalesce(agrees, F.lit(False)), second["name"]).otherwise("")).otherwise(F.col("sublineage")))


def summary(assigned: DataFrame) -> DataFrame:
    """One row of ``assign``'s result: shares of lineages and sub-lineages, counts of sub-lineages (each 'name:value;...' falling), and whether either had too few reads."""
    cells = []
    for level, column in (("lineage", "lineage"), ("sublineage", "sublineage")):
        found = prevalence(assigned, column, level)
        text = lambda v: F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["name"], v(x))), ";")
        order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n", "pct")))
        one = found.agg(order.alias("l"), F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("total"), F.coalesce(F.first("enough"), F.lit(False)).alias("enough"))
        note = F.concat(F.when(F.col("enough"), F.lit("INFO:")).otherwise(F.lit("WARN:low_")), F.lit(f"{level}_counts:"), F.col("total"))
        counts = [text(lambda x: x["n"].cast("string")).alias("sublineage_counts")] if level == "sublineage" else []
        cells.append(one.select(text(lambda x: six(x["pct"])).alias(f"{level}s"), *counts, note.alias(f"{level}_note")))
    return cells[0].join(cells[1], how="cross")  # one row each


def with_zeros(lists: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """``lists`` whose ``column`` also names, behind the groups it has, all other groups of ``names`` with nothing shared, in order of name. One row of names is broadcast."""
    every = F.broadcast(names.agg(F.sort_array(F.collect_set(name)).alias("_names")))
    rest = F.transform(F.array_except("_names", F.transform(column, lambda g: g["name"])), lambda n: F.struct(n.alias("name"), F.lit(0.0).alias("sim"), F.lit(0).cast("long").alias("shared")))
    return lists.join(every, how="cross").withColumn(column, F.concat(column, rest)).drop("_names")


def prevalence(assigned: DataFrame, name: str, level: str) -> DataFrame:
    """(level, name, n, pct, enough): shares of the assignments; ``enough`` is false below 1000 of them in all."""
    counted = assigned.filter(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counted.select(F.lit(level).alias("level"), "name", "n", (F.col("n") / total).alias("pct"), (total >= 1000).alias("enough"))


def prevalence_multi(overlap: DataFrame, group: str, least_sim: float = 0.01) -> DataFrame:
    """The same where every group above ``least_sim`` counts, several a read."""
    return prevalence(overlap.filter(F.col("sim") > least_sim), group, group)


def coinfection(shares: DataFrame, least: float = 0.05) -> DataFrame:
    """(level, n_over, coinfected): whether two or more names hold over ``least``."""
    return shares.groupBy("level").agg(F.count_if(F.col("pct") > least).alias("n_over")).withColumn("coinfected", F.col("n_over") >= 2)


def collapse(shares: DataFrame) -> DataFrame:
    """Sub-lineage shares summed by their first letter and normalised."""
    summed = shares.groupBy(lineage_of(F.col("name"), 1).alias("name")).agg(F.sum("pct").alias("p"))
    return summed.select("name", (F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(0)))).alias("pct"))
