"""Variant calls from k-mer depth: a depth profile, low places, perturbed k-mers that restore the depth, and their roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators.sketch import depth

#: References are cut into pieces of so many places, so that no row holds all k-mers of a chromosome and no window spans one.
PIECE = 1 << 16


def _lead_in(window: int) -> int:
    """Places a piece has before its own: the window's, and one for the base before a place."""
    return max(window, 1)


def pieces(refs: DataFrame, k: int, window: int, piece: int = PIECE) -> DataFrame:
    """(id, part, seq): letters from ``part * piece`` on, enough for the places that the part answers for, with a window's places before them and a place behind them. One pass over a sequence."""
    extra = _lead_in(window) + k
    cut = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{piece + extra}}})).{{1,{piece}}}"), 1)
    return refs.select("id", F.posexplode(cut).alias("part", "seq"))


def places(refs: DataFrame, depths: DataFrame, k: int, window: int = 100, piece: int = PIECE, **how) -> DataFrame:
    """(ref_id, pos, kmer, before, after, avg_depth, depth): each k-mer of the references with those beside it, its depth, and the mean depth over the last ``window`` places, rounded down."""
    lead = _lead_in(window)
    table = pieces(refs, k, window, piece).select("id", "part", F.posexplode_outer(K.kmers(F.col("seq"), k)).alias("i", "kmer")).filter(F.col("kmer").isNotNull())
    found = table.withColumn("hash", K.kmer_hash(F.col("kmer"), how.get("name", "md5"), how.get("canonical", False))).join(depths, "hash", "left")
    masked = F.lit(True) if not how.get("valid_only") else K.is_valid(F.col("kmer"))
    found = found.withColumn("depth", F.when(masked, F.coalesce("depth", F.lit(0))).otherwise(0))
    run = Window.partitionBy("id", "part").orderBy("i")
    trailing = run.rowsBetween(1 - window, 0)
    found = found.withColumns({"avg_depth": F.floor(F.sum("depth").over(trailing) / F.count("*").over(trailing)), "before": F.lag("kmer").over(run), "after": F.lead("kmer").over(run)})
    own = ((F.col("part") == 0) | (F.col("i") >= lead)) & (F.col("i") < piece + lead)
    return found.filter(own).select(F.col("id").alias("ref_id"), (F.col("part").cast("long") * piece + F.col("i")).alias("pos"), "kmer", "before", "after", "avg_depth", "depth")


def depth_profile(refs: DataFrame, depths: DataFrame, k: int, window: int = 100, piece: int = PIECE, **how) -> DataFrame:
    """(ref_id, pos, kmer, avg_depth, depth): depth of each reference k-mer and its mean over the last ``window`` places, rounded down."""
    return places(refs, depths, k, window, piece, **how).select("ref_id", "pos", "kmer", "avg_depth", "depth")


def candidates(profile: DataFrame, k: int, low: float = 0.5, strict: bool = False, pos_fix: bool = False, extras: bool = False, **how) -> DataFrame:
    """(ref_id, j, pos, orig, alt, kind, avg_depth, depth, hash): perturbed k-mers at ``places`` whose depth is below ``low`` of the mean.

    Only such places are perturbed. A deletion starts one place earlier and is reported one base on; ``pos_fix`` reports the base itself,
    ``strict`` leaves out deletions that only restate the k-mer before. ``extras`` adds two-base deletions and one-base insertions.
    The bases around a place come from the k-mers beside it, so no row carries a reference.
    """
    lows = profile.filter(F.col("depth") < low * F.col("avg_depth")).withColumnRenamed("pos", "j")
    keep = ["ref_id", "j", "avg_depth", "depth"]
    snp = lows.select(*keep, F.explode(K.substitutions(F.col("kmer"))).alias("c")).select(*keep, (F.col("j") + F.col("c.at") + 1).alias("pos"), "c.orig", "c.alt", F.lit("snp").alias("kind"), F.col("c.kmer").alias("kmer"))
    out = snp
    for width in (1, 2) if extras else (1,):
        stretch = F.concat(F.substring("before", 1, 1), "kmer", *([F.coalesce(F.substring("after", k, 1), F.lit(""))] if width > 1 else []))
        dels = lows.filter("j > 0").select(*keep, "before", F.explode(K.deletions(stretch, width)).alias("c"))
        dels = dels.filter(F.length("c.kmer") == k)
        dels = dels.filter(F.col("c.kmer") != F.col("before")) if strict else dels
        out = out.unionByName(dels.select(*keep, (F.col("j") + F.col("c.at") + (0 if pos_fix else 1)).alias("pos"), "c.orig", F.lit("-").alias("alt"), F.lit("del").alias("kind"), F.col("c.kmer").alias("kmer")))
    if extras:
        ins = lows.select(*keep, F.explode(K.insertions(F.col("kmer"))).alias("c"))
        out = out.unionByName(ins.select(*keep, (F.col("j") + F.col("c.at")).alias("pos"), F.lit("-").alias("orig"), "c.alt", F.lit("ins").alias("kind"), F.col("c.kmer").alias("kmer")))
    return out.withColumn("hash", K.kmer_hash(F.col("kmer"), how.get("name", "md5"), how.get("canonical", False))).drop("kmer")


def rescued(found: DataFrame, depths: DataFrame, snp_share: float = 0.1, del_share: float = 0.9) -> DataFrame:
    """Candidates whose k-mer is deep enough: a substitution at ``snp_share`` of the mean or more and deeper than the place, others above ``del_share``."""
    deep = found.join(depths.withColumnRenamed("depth", "alt_depth"), "hash")
    good = F.when(F.col("kind") == "snp", (F.col("alt_depth") >= snp_share * F.col("avg_depth")) & (F.col("alt_depth") > F.col("depth"))).otherwise(F.col("alt_depth") > del_share * F.col("avg_depth"))
    return deep.filter(good).drop("hash")


def roll_up(calls: DataFrame) -> DataFrame:
    """(ref_id, pos, orig, alt, kc, md, rd, od): supporting k-mers, largest alternative depth, largest mean, largest depth."""
    return calls.groupBy("ref_id", "pos", "orig", "alt").agg(F.count("*").alias("kc"), F.max("alt_depth").alias("md"), F.max("avg_depth").alias("rd"), F.max("depth").alias("od"))


def call(refs: DataFrame, reads: DataFrame | None, k: int, window: int = 100, depths: DataFrame | None = None, name: str = "md5", canonical: bool = False, valid_only: bool = False, **options) -> DataFrame:
    """Rolled-up variants of ``refs`` by the reads' k-mers, or by ``depths`` counted before."""
    how = {"name": name, "canonical": canonical, "valid_only": valid_only}
    depths = depth(reads, [k], **how) if depths is None else depths
    profile = places(refs, depths, k, window, **how)
    shares = {o: options.pop(o) for o in ("snp_share", "del_share") if o in options}
    return roll_up(rescued(candidates(profile, k, **how, **options), depths, **shares))
