"""Hierarchical budgeting of sources, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import durable

#: Order hashes are summed by two hex digits at a time, 256 buckets a leaf and step: first all of a leaf, then the bucket at its cut.
#: Only the last step's bucket at the cut, one row in 65536, is ordered row by row.
STEPS = (2, 4)
#: Leaves up to this number (about 100 bytes each) are broadcast; more of them are joined by a shuffle.
FEW = 50_000


def tokens(text: Column) -> Column:
    """White-space separated words, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def order_hash(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(levels: list[str], weights: dict[tuple, float]) -> Column:
    """Weight of the node named by ``levels`` among its siblings; 1 where none is given."""
    path = F.concat_ws("\x1f", *levels)
    given = {k: v for k, v in weights.items() if len(k) == len(levels)}
    return reduce(lambda c, kv: F.when(path == "\x1f".join(kv[0]), F.lit(float(kv[1]))).otherwise(c), given.items(), F.lit(1.0))


def budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple, float], total: Column) -> DataFrame:
    """``leaves(levels..., t, cap)`` with ``budget``: the total runs down the tree by weight, level by level.

    A node's capacity is what its leaves can give. Among siblings the share is min(capacity, rate * weight) at the one rate that
    spends the parent's budget: what a short node can't use goes to its siblings first, and only what they can't use
    shows as the parent's own capacity, which its siblings take up a level higher. The rate is the largest
    (budget - capacities before) / (weights from here on) in order of capacity per weight.
    """
    nodes = leaves.withColumn("budget", F.least(total.cast("double"), F.sum("cap").over(Window.partitionBy(F.lit(0)))))
    for depth in range(1, len(levels) + 1):
        here, parent = levels[:depth], levels[: depth - 1] or [F.lit(0)]
        level = nodes.groupBy(*here).agg(F.sum("cap").cast("double").alias("cap_n"), F.first("budget").alias("above")).withColumn("w", _weight(here, weights))
        run = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap_n") / F.col("w")).otherwise(F.lit(float("inf"))), *here)
        level = level.withColumns({"before": F.sum("cap_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), "rest": F.sum("w").over(run.rowsBetween(0, Window.unboundedFollowing))})
        rate = F.max(F.try_divide(F.col("above") - F.coalesce("before", F.lit(0.0)), F.col("rest"))).over(Window.partitionBy(*parent))
        level = level.withColumn("share", F.least(F.col("cap_n"), F.coalesce(rate, F.lit(0.0)) * F.col("w"))).select(*here, "share")
        nodes = nodes.join(level, here).withColumn("budget", F.col("share")).drop("share")
    return nodes.withColumn("budget", F.floor(F.col("budget") + F.lit(0.0005)).cast("long"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, float], fraction: float, max_epochs: int = 1, seed: str = "mix") -> DataFrame:
    """``docs`` rows chosen to meet the tree's weights, once an epoch chosen, with ``epoch``, ``tokens`` and the levels as ``mix_<level>``.

    The total is ``fraction`` of all tokens. A leaf gives whole epochs while its budget lasts, then the prefix of the next epoch, in
    that epoch's seeded order, whose documents begin before the budget's end. Hot leaves: order hashes are summed in 256
    buckets a leaf before any shuffle, then the bucket at the cut in 256 finer ones; what lies before the cut is taken, what lies after
    it is left, and only the finest bucket at the cut is ordered. Null level values are the empty name, null text has no tokens (its rows go with the prefix); rows of one id keep one place in order. Columns
    of the added names are replaced, all others stay. An empty table gives an empty one.
    """
    names = {f"mix_{k}": F.coalesce(c.cast("string"), F.lit("")) for k, c in levels.items()}
    keys = list(names)
    docs = docs.drop("epoch", "tokens", *keys)
    # the whole row travels as one struct, so that no column of it meets a name used here
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *(c.alias(k) for k, c in names.items()), tokens(F.col("text")).alias("tokens"))
    narrow = durable(sized.select("doc_id", *keys, "tokens"))
    leaves = durable(narrow.groupBy(*keys).agg(F.sum("tokens").alias("t")))
    n_leaves, all_tokens = leaves.agg(F.count("*"), F.sum("t")).first()
    near = F.broadcast if n_leaves <= FEW else lambda df: df
    shares = budgets(leaves.withColumn("cap", F.col("t") * max_epochs), keys, weights, F.lit(int((all_tokens or 0) * fraction)))
    shares = shares.withColumns({"whole": F.when(F.col("t") > 0, F.floor(F.col("budget") / F.col("t"))).otherwise(F.lit(0)).cast("int")}).withColumn("part", F.col("budget") - F.col("whole") * F.col("t"))
    shares = shares.select(*keys, "whole", "part", F.lit("").alias("cut"), F.lit(0).cast("long").alias("start"))

    def placed(df: DataFrame) -> DataFrame:
        return df.join(near(shares), keys).withColumn("h", order_hash(seed, F.col("whole"), F.col("doc_id")))

    run = Window.partitionBy(*keys).orderBy("b")
    for digits in STEPS:
        here = placed(narrow).filter(F.col("h").startswith(F.col("cut"))).withColumn("b", F.substring("h", 1, digits))
        sums = here.groupBy(*keys, "b", "part", "start").agg(F.sum("tokens").alias("n")).withColumn("upto", F.col("start") + F.sum("n").over(run))
        cuts = sums.filter((F.col("upto") - F.col("n") < F.col("part")) & (F.col("upto") >= F.col("part")))
        cuts = cuts.groupBy(*keys).agg(F.min("b").alias("cut"), F.min_by(F.col("upto") - F.col("n"), "b").alias("start"))
        shares = durable(shares.drop("cut", "start").join(cuts, keys, "left"))
    row = Window.partitionBy(*keys).orderBy("h", "doc_id")
    last = placed(narrow).filter(F.col("h").startswith(F.col("cut"))).groupBy(*keys, "doc_id", "h", "start", "part").agg(F.sum("tokens").alias("tokens"))
    last = last.withColumn("upto", F.col("start") + F.sum("tokens").over(row)).filter((F.col("upto") - F.col("tokens") < F.col("part")) & (F.col("part") > 0))
    last = last.select(*keys, F.col("doc_id").alias("last_id"), F.lit(True).alias("last"))
    full = placed(sized)
    # only the cut's bucket meets the ordered ids
    at_cut = F.coalesce(F.col("h").startswith(F.col("cut")), F.lit(False))
    outside = full.filter(~at_cut).withColumn("in_part", (F.col("part") > 0) & (F.col("cut").isNull() | (F.col("h") < F.col("cut"))))
    match = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.doc_id").eqNullSafe(F.col("r.last_id"))]
    inside = full.filter(at_cut).alias("l").join(last.alias("r"), reduce(Column.__and__, match), "left").select("l.*", F.coalesce("r.last", F.lit(False)).alias("in_part"))
    chosen = outside.unionByName(inside).withColumn("times", F.col("whole") + F.col("in_part").cast("int")).filter("times > 0")
    return chosen.select("row.*", *keys, "tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
