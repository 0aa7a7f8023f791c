"""Sketches, depths and sample frequencies. Tables have ``id`` and ``seq``; hash tables are long: one row a hash.

``**how`` is how k-mers are hashed: ``name``, ``canonical``, ``valid_only`` (see functions/kmers.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.cluster import durable, spread  # noqa: F401
from kmerloom.functions import kmers as K
from kmerloom.functions import packed
from kmerloom.functions.arrays import NAMES
from kmerloom.functions.murmur import with_murmur3
from kmerloom.operators import buckets, counters, stretches

#: Deep k-mers (a long each) up to this number are broadcast; beyond it the join shuffles by k-mer.
DEEP = 4_000_000


#: Characters of a task whose exploded k-mers are sorted in memory.
SORTED = 4_000_000
#: Characters of a task whose k-mers are folded in memory.
FOLDED = 8_000_000


def by_arrays(name: str = "md5", canonical: bool = False, valid_only: bool = False) -> bool:
    """Whether hashes are made as arrays (functions/arrays.py). Masked Murmur3 ones are made without Python (functions/murmur.py)."""
    return name in NAMES and not (name == "murmur3" and valid_only)


def kmer_table(seqs: DataFrame, ks: list[int]) -> DataFrame:
    """(id, pos, k, kmer): every k-mer of every k."""
    one = [seqs.select("id", F.posexplode_outer(K.kmers(F.col("seq"), k)).alias("pos", "kmer")).filter(F.col("kmer").isNotNull()).select("id", "pos", F.lit(k).alias("k"), "kmer") for k in ks]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    return out


def hash_table(seqs: DataFrame, ks: list[int], name: str = "md5", canonical: bool = False, valid_only: bool = False) -> DataFrame:
    """(id, pos, k, hash), duplicates kept; masked k-mers are left out. Masked Murmur3 hashes are made without Python (functions/murmur.py)."""
    if name == "murmur3" and valid_only:
        one = [with_murmur3(kmer_table(seqs, [k]).filter(K.is_valid(F.col("kmer"))), "kmer", k, canonical=canonical).drop("kmer") for k in ks]
        return reduce(DataFrame.unionByName, one)
    table = kmer_table(seqs, ks)
    table = table.filter(K.is_valid(F.col("kmer"))) if valid_only else table
    return table.select("id", "pos", "k", K.kmer_hash(F.col("kmer"), name, canonical).alias("hash"))


def sketches(seqs: DataFrame, ks: list[int], s: int | None = 1000, name: str = "md5", canonical: bool = False, valid_only: bool = False) -> DataFrame:
    """(id, sketch): the s smallest distinct hashes of a row, made in the row as arrays, without a shuffle.

    Masked Murmur3 hashes are made of exploded k-mers: sequences are dealt by id first, so that what is shuffled is sequences and k-mers come together where they are (to so many
    tasks that a task sorts its own in memory); rows of one id are one sequence then.
    """
    if name == "murmur3" and valid_only:
        chars = seqs.agg(F.sum(F.length("seq"))).first()[0] or 0
        dealt = seqs.select("id", "seq").repartition(max(chars // SORTED + 1, seqs.sparkSession.sparkContext.defaultParallelism), "id")
        valid = F.when(K.is_valid(F.col("kmer")), F.col("kmer"))
        one = [with_murmur3(dealt.select("id", F.explode_outer(K.kmers(F.col("seq"), k)).alias("kmer")).select("id", valid.alias("kmer")), "kmer", k, canonical=canonical) for k in ks]
        return gathered(reduce(DataFrame.unionByName, one), s, name)
    return seqs.select("id", K.sketch(F.col("seq"), ks, s, name, canonical, valid_only).alias("sketch"))


def long_form(sk: DataFrame, *keep: str) -> DataFrame:
    """(id, ..., hash). explode_outer keeps the optimizer from copying the sketch expression into a filter below it."""
    return sk.select("id", *keep, F.explode_outer("sketch").alias("hash")).filter(F.col("hash").isNotNull())


def counts_by_sequence(seqs: DataFrame, ks: list[int], **how) -> DataFrame:
    """(id, hash, n): occurrences within a sequence."""
    return hash_table(seqs, ks, **how).groupBy("id", "hash").agg(F.count("*").alias("n"))


def depth(seqs: DataFrame, ks: list[int], least: int = 1, **how) -> DataFrame:
    """(hash, depth): occurrences over all sequences, of hashes with ``least`` of them or more.

    Hashes are folded as arrays in buckets (operators/buckets.py), k-mers of one length that is not small where their stretches of text meet (operators/stretches.py). Where they can't be made as arrays, k-mers are folded before they are hashed (by tasks of few enough characters to hold their own), as a long each where they are up to 31 letters A, C, G, T, cut out of packed windows, else as text (of both strands the one that comes first, if canonical), so
    the shuffle moves no hashes and a k-mer is hashed once.
    """
    name, canonical, valid_only = how.get("name", "md5"), how.get("canonical", False), how.get("valid_only", False)
    if by_arrays(name, valid_only=valid_only):
        return stretches.depth(seqs, ks[0], least, **how) if len(ks) == 1 and ks[0] >= stretches.LEAST else buckets.depth(seqs, ks, least, **how)
    counted = []
    chars = seqs.agg(F.sum(F.length("seq"))).first()[0] or 0
    seqs = seqs.select("seq")
    seqs = seqs.repartition(chars // FOLDED + 1) if chars > FOLDED * seqs.sparkSession.sparkContext.defaultParallelism else seqs
    for k in ks:
        fast = name == "murmur3" and valid_only
        if k <= packed.LONGEST:
            one = packed.spelled(seqs, k, canonical, valid_only).groupBy("code", "text").agg(F.count("*").alias("n"))
            one = one if fast else one.select(F.coalesce("text", packed.unpack(F.col("code"), k)).alias("kmer"), "n")
        else:
            table = kmer_table(seqs, [k]).select("kmer")
            one = packed.folded(table.filter(K.is_valid(F.col("kmer"))) if valid_only else table, k, canonical)
        by_code = fast and k <= packed.LONGEST
        hashed = with_murmur3(one, "text" if by_code else "kmer", k, canonical=canonical, code="code" if by_code else None) if fast else one.withColumn("hash", K.kmer_hash(F.col("kmer"), name, canonical))
        counted.append(hashed.select("hash", F.col("n").alias("depth")))
    out = counted[0] if len(ks) == 1 else reduce(DataFrame.unionByName, counted).groupBy("hash").agg(F.sum("depth").alias("depth"))
    return out if least <= 1 else out.filter(F.col("depth") >= least)


def slot_depth(seqs: DataFrame, ks: list[int], slots: int, name: str = "md5", **how) -> DataFrame:
    """(slot, depth): the counter of fixed size. Hashes of one slot are counted together, so a depth is never too small; rows never exceed ``slots``."""
    if name in NAMES:
        return buckets.slot_depth(seqs, ks, slots, name=name, **how)
    return hash_table(seqs, ks, name, **how).groupBy(K.slot(F.col("hash"), slots, name).alias("slot")).agg(F.count("*").alias("depth"))


def approximate_depth(seqs: DataFrame, ks: list[int], eps: float = 1e-4, confidence: float = 0.99, **how) -> bytes:
    """A count-min sketch of the hashes, whose size (by ``eps`` and ``confidence`` alone) doesn't grow with the input."""
    table = hash_table(seqs, ks, **how)
    return table.agg(F.count_min_sketch("hash", F.lit(eps), F.lit(confidence), F.lit(42)).alias("cms")).first().cms


def sample_frequency(seqs: DataFrame, ks: list[int], mode: str = "samples", **how) -> DataFrame:
    """(hash, n_refs): distinct sequences that hold a hash; ``mode='occurrence'`` counts every occurrence."""
    table = hash_table(seqs, ks, **how)
    table = table if mode == "occurrence" else table.select("id", "hash").distinct()
    return table.groupBy("hash").agg(F.count("*").alias("n_refs"))


def gathered(long: DataFrame, s: int | None, name: str = "md5") -> DataFrame:
    """(id, sketch) from the long form. A list holds the distinct hashes of one sequence, which were one row before."""
    return long.groupBy("id").agg(K.bottom(F.collect_set("hash"), s, name).alias("sketch"))


def masked_sketches(seqs: DataFrame, ks: list[int], s: int | None, min_depth: int, over: DataFrame | None = None, depths: DataFrame | counters.Counters | counters.DeepHashes | None = None, slots: int | None = None, name: str = "md5", canonical: bool = False, valid_only: bool = False) -> DataFrame:
    """(id, sketch) of the hashes that occur ``min_depth`` times or more in ``over`` (the sequences themselves).

    Where hashes are made as arrays, blocks of rows ask the buckets of all hashes about their own (``masked`` of operators/stretches.py for one length that is not small and depths that aren't given, else of operators/buckets.py). Else depths are counted on a long a k-mer, folded before their shuffle; only the deep ones (broadcast up to ``DEEP`` of them, counted) meet the
    k-mers again, and only what is left is hashed and gathered. ``depths(hash, depth)`` is a table counted before, ``slots`` counts
    in that many counters instead, where a rare k-mer may pass with its slot; the deep counters (up to ``DEEP``) are asked in the row. ``depths`` may also be ``Counters`` or ``DeepHashes`` (operators/counters.py): then
    every row asks them about its own hashes and nothing is shuffled.
    """
    if isinstance(depths, (counters.Counters, counters.DeepHashes)):
        if name in NAMES:
            return seqs.select("id", K.sketch(F.col("seq"), ks, s, name, canonical, valid_only, counters.keeps(seqs.sparkSession, depths, min_depth)).alias("sketch"))
        kept = counters.keep_deep(seqs.sparkSession, depths, min_depth, name)(K.hashes(F.col("seq"), ks, name, canonical, valid_only))
        return seqs.select("id", K.bottom(kept, s, name).alias("sketch"))
    how = {"name": name, "canonical": canonical, "valid_only": valid_only}
    if name in NAMES and slots and slots <= DEEP and depths is None:
        deep_slots = slot_depth(over if over is not None else seqs, ks, slots, **how).filter(F.col("depth") >= min_depth)
        return seqs.select("id", K.sketch(F.col("seq"), ks, s, **how, keep=counters.keeps_slots(deep_slots, slots)).alias("sketch"))
    if name in NAMES and not slots and depths is None and len(ks) == 1 and ks[0] >= stretches.LEAST:
        return stretches.masked(seqs, ks[0], s, min_depth, over, **how)
    if name in NAMES and not slots:
        return buckets.masked(seqs, ks, s, min_depth, over, depths, **how)
    long = kmer_table(seqs, ks)
    long = long.filter(K.is_valid(F.col("kmer"))) if valid_only else long
    hashed = K.kmer_hash(F.col("kmer"), name, canonical)
    if depths is not None:
        key, deep = hashed, depths.filter(F.col("depth") >= min_depth).select(F.col("hash").alias("key"))
    else:
        key = K.slot(hashed, slots, name) if slots else K.depth_key(F.col("kmer"), canonical)
        counted = kmer_table(over, ks) if over is not None else long
        counted = counted.filter(K.is_valid(F.col("kmer"))) if valid_only else counted
        deep = counted.groupBy(key.alias("key")).agg(F.count("*").alias("depth")).filter(F.col("depth") >= min_depth).select("key")
    deep = durable(deep)
    deep = F.broadcast(deep) if deep.count() <= DEEP else deep
    kept = long.select("id", "kmer", key.alias("key")).join(deep, "key", "left_semi").select("id", hashed.alias("hash"))
    return all_ids(seqs, gathered(kept, s, name), name)


def all_ids(seqs: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    none = F.array().cast(f"array<{K.hash_type(name)}>")
    return seqs.select("id").join(kept, "id", "left").withColumn("sketch", F.coalesce("sketch", none))


def max_samples_sketches(seqs: DataFrame, ks: list[int], s: int | None, max_samples: int, strict: bool = False, mode: str = "samples", name: str = "md5", **how) -> DataFrame:
    """(id, sketch) of the hashes that at most ``max_samples`` sequences hold; ``strict``: fewer (informative k-mers)."""
    freq = sample_frequency(seqs, ks, mode, name=name, **how)
    freq = freq.filter(F.col("n_refs") < max_samples) if strict else freq.filter(F.col("n_refs") <= max_samples)
    table = hash_table(seqs, ks, name, **how).select("id", "hash").distinct()
    return all_ids(seqs, gathered(table.join(freq, "hash").select("id", "hash"), s, name), name)


def _smallest(long: DataFrame, group: str, s: int, name: str) -> DataFrame:
    """The rows of each group's s smallest hashes. Spark cuts a group to s rows before the shuffle, so a hot group isn't gathered."""
    run = Window.partitionBy(group).orderBy(K.order_key(F.col("hash"), name))
    return long.withColumn("r", F.row_number().over(run)).filter(F.col("r") <= s)


def merge(sk: DataFrame, group: str, s: int, name: str = "md5") -> DataFrame:
    """(group, sketch): union of a group's sketches, s smallest."""
    long = sk.select(F.col(group), F.explode_outer("sketch").alias("hash")).filter(F.col("hash").isNotNull()).distinct()
    listed = _smallest(long, group, s, name).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("r", "hash"))).alias("l"))
    return listed.select(group, F.transform("l", lambda x: x["hash"]).alias("sketch"))


def merge_with_counts(sk: DataFrame, group: str, s: int, name: str = "md5") -> DataFrame:
    """(group, hash, n): union of a group's sketches, the 2s smallest hashes, in how many sketches each."""
    long = sk.select(F.col(group), F.explode_outer("sketch").alias("hash")).filter(F.col("hash").isNotNull())
    return _smallest(long.groupBy(group, "hash").agg(F.count("*").alias("n")), group, 2 * s, name).drop("r")


def by_name(seqs: DataFrame) -> DataFrame:
    """One row a name, the last in file order."""
    return seqs.groupBy("name").agg(F.max_by("seq", "ord").alias("seq"))


def search(seqs: DataFrame, wanted: DataFrame, ks: list[int], canonical: bool = False) -> DataFrame:
    """(id, kmers): each sequence's k-mers of the list ``wanted(kmer)``, in order, comma-joined; sequences without one are left out.

    ``canonical``: a k-mer also matches by its other strand. A filter of the list (Bloom, built by all tasks) is asked in the row, so that of the k-mers only
    those that the list may hold are exploded and joined; a list too long for a filter of bounded size goes without.
    """
    strand = lambda c: F.least(c, K.reverse_complement(c)) if canonical else c
    keys = durable(wanted.select(strand(F.col("kmer")).alias("_w")).filter(F.col("_w").isNotNull()).distinct())
    known = counters.list_filter(keys.select(F.xxhash64("_w").alias("hash")))
    if known is None:
        listed = kmer_table(seqs, ks).withColumn("_w", strand(F.col("kmer")))
    else:
        held = counters.may_hold(seqs.sparkSession, known)

        def asked(k: int) -> DataFrame:
            each = seqs.select("id", K.kmers(F.col("seq"), k).alias("l"))
            said = each.select("id", "l", held(F.transform("l", lambda x: F.xxhash64(strand(x)))).alias("s"))
            numbered = F.filter(F.transform(F.arrays_zip("l", "s"), lambda x, i: F.struct(i.alias("pos"), x["l"].alias("kmer"), x["s"].alias("s"))), lambda x: x["s"])
            return said.select("id", F.explode(numbered).alias("x")).select("id", "x.pos", F.lit(k).alias("k"), "x.kmer", strand(F.col("x.kmer")).alias("_w"))

        listed = reduce(DataFrame.unionByName, map(asked, ks))
    found = listed.join(keys, "_w", "left_semi")
    gathered_ = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "pos", "kmer"))).alias("l"))
    return gathered_.select("id", F.array_join(F.transform("l", lambda x: x["kmer"]), ",").alias("kmers"))
