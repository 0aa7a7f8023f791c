"""Overlap of read sketches with reference sketches, arg-max with its tie rules, and the verdicts on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions import arrays as A
from kmerloom.operators.sketch import durable, long_form

#: Reference hashes up to this number (about 40 bytes each) are broadcast; beyond it the join shuffles by hash.
FEW = 1_000_000


@dataclass
class Panel:
    """An inverted index of few sketches: their hashes ascending, each with the place of its sketch, and which leading bits occur at all."""

    hashes: np.ndarray
    places: np.ndarray
    some: np.ndarray

    def shared(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, n) of all lists and sketches that share n hashes, by row and place."""
        values, ok = A.numbers(lists.flatten())
        return self.shared_numbers(values, ok, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

    def shared_numbers(self, values: np.ndarray, ok: np.ndarray | bool, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of lists of numbers, given as all of them and how many each list has."""
        at = np.flatnonzero(ok & self.some[values >> np.uint64(42)])
        low = np.searchsorted(self.hashes, values[at])
        n = np.searchsorted(self.hashes, values[at], "right") - low
        row = np.searchsorted(np.cumsum(sizes), at, "right")
        found = self.places[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
        keys, counts = np.unique(np.repeat(row, n) * (int(self.places.max(initial=0)) + 1) + found, return_counts=True)
        return *np.divmod(keys, int(self.places.max(initial=0)) + 1), counts


def panel_of(index: DataFrame, place: str = "place", distinct: bool = False) -> Panel | None:
    """The panel of ``index(place, hash)``, whose size was counted; None where hashes are neither longs nor 16 hex digits."""
    table = index.select(F.col(place).cast("long").alias("place"), "hash").toArrow()
    hashes, ok = A.numbers(table["hash"].combine_chunks() if table.num_rows else pa.array([], pa.int64()))
    if not ok.all():
        return None
    places = table["place"].to_numpy().astype(np.int64)
    order = np.lexsort((places, hashes))
    hashes, places = hashes[order], places[order]
    if distinct and len(hashes):
        first = np.append(True, (hashes[1:] != hashes[:-1]) | (places[1:] != places[:-1]))
        hashes, places = hashes[first], places[first]
    some = np.zeros(1 << 22, bool)
    some[hashes >> np.uint64(42)] = True
    return Panel(hashes, places, some)


def asks(spark: SparkSession, panel: Panel) -> Callable[[Column], Column]:
    """A function of a column of sketches: their size (0 for null), and what they share with each sketch of the panel (``l``: place, shared)."""
    known = spark.sparkContext.broadcast(panel)

    @F.arrow_udf("struct<size:int,l:array<struct<place:long,shared:long>>>")
    def asked(lists: pa.Array) -> pa.Array:
        row, place, n = known.value.shared(lists)
        sizes = lists.value_lengths().fill_null(0).cast(pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64())], ["place", "shared"])
        return pa.StructArray.from_arrays([sizes, A.listed(pairs, np.bincount(row, minlength=len(lists)))], ["size", "l"])

    return asked


def asks_texts(spark: SparkSession, panel: Panel, ks: list[int], s: int | None, how: dict) -> Callable[[Column], Column]:
    """The same of a column of texts, by the s smallest of their hashes, which are made and asked as arrays and never listed."""
    known = spark.sparkContext.broadcast(panel)

    @F.arrow_udf("struct<size:int,l:array<struct<place:long,shared:long>>>")
    def asked(texts: pa.Array) -> pa.Array:
        sizes, pairs = [], []
        for at, values, n in A.hashed_texts(texts, ks, **how):
            values, n = A.smallest(values, n, s)
            row, place, shared = known.value.shared_numbers(values, True, n)
            sizes.append(n)
            pairs.append((row + at, place, shared))
        row, place, shared = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in range(3))
        listed = A.listed(pa.StructArray.from_arrays([pa.array(place, pa.int64()), pa.array(shared, pa.int64())], ["place", "shared"]), np.bincount(row, minlength=len(texts)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int32()), listed], ["size", "l"])

    return asked


def hits(reads: DataFrame, refs: DataFrame, texts: DataFrame | None = None, ks: list[int] | None = None, s: int | None = None, **how) -> DataFrame:
    """(read_id, ref_id, shared, read_size): pairs with a common hash, by an inverted index of the references; a read without any has one row with a null reference.

    The index (counted, so hand in ``refs`` as a table) is broadcast only when small, and asked by every read in its row: then nothing but what is found is shuffled, by read. Otherwise
    (or where hashes are neither longs nor 16 hex digits) both sides shuffle by hash: a read without hashes goes by its id, so that empty sketches
    don't meet in one task, and a hash that most reads hold is a skewed key that AQE splits (the index has one row a reference for it).
    With ``texts(id, seq)``, of which ``reads`` are the sketches by the other arguments, an index that is broadcast is asked by the texts' own hashes, and no sketch is made.
    """
    index = long_form(refs).select(F.col("id").alias("ref_id"), F.col("hash").alias("_hash"))
    names = [r[0] for r in refs.select("id").distinct().limit(FEW + 1).collect()] if (few := index.count() <= FEW) else []
    if few and len(names) <= FEW:
        spark, kind = reads.sparkSession, refs.schema["id"].dataType.simpleString()
        named = spark.createDataFrame(list(enumerate(names)), f"place long, ref_id {kind}")
        panel = panel_of(index.join(F.broadcast(named), "ref_id").select("place", F.col("_hash").alias("hash")))
        if panel is not None:
            asked = reads.select(F.col("id").alias("read_id"), asks(spark, panel)(F.col("sketch")).alias("a")) if texts is None else texts.select(F.col("id").alias("read_id"), asks_texts(spark, panel, ks, s, how)(F.col("seq")).alias("a"))
            listed = asked.select("read_id", F.col("a.size").alias("size"), F.explode_outer("a.l").alias("x")).select("read_id", "size", "x.place", "x.shared")
            summed = listed.groupBy("read_id", "place").agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"), F.max("size").alias("size"))
            sized = summed.join(F.broadcast(named), "place", "left")
            return sized.select("read_id", "ref_id", "shared", F.max("size").over(Window.partitionBy("read_id")).alias("read_size"))
    long = reads.select(F.col("id").alias("read_id"), F.posexplode_outer("sketch").alias("pos", "hash"))
    if few:
        found = long.join(F.broadcast(index), F.col("hash") == F.col("_hash"), "left")
    else:
        key = F.coalesce(F.col("hash").cast("string"), F.concat(F.lit("none "), F.col("read_id").cast("string")))
        found = long.withColumn("_key", key).join(index.withColumn("_hash", F.col("_hash").cast("string")), F.col("_key") == F.col("_hash"), "left")
    return found.groupBy("read_id", "ref_id").agg(F.count("ref_id").alias("shared"), F.max("pos").alias("pos")).select(
        "read_id", "ref_id", "shared", (F.coalesce(F.max("pos").over(Window.partitionBy("read_id")), F.lit(-1)) + 1).alias("read_size")
    )


def pairs(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """(read_id, ref_id, shared, read_size) of read and reference sketches with a common hash."""
    return hits(reads, refs).filter(F.col("ref_id").isNotNull())


def small_panel(refs: DataFrame) -> tuple[Panel, list]:
    """The panel of ``refs(id, ord, sketch)`` and its ids, both in order of ``ord``; its hashes are counted first and may be ``FEW`` at most."""
    total = refs.agg(F.sum(F.size("sketch"))).first()[0] or 0
    if total > FEW:
        raise ValueError(f"a panel of {total} hashes is too large to travel with every task (limit {FEW}); use the joined form")
    rows = refs.agg(F.array_sort(F.collect_list(F.struct("ord", "id", "sketch"))).alias("l"))
    ids = [r.id for r in rows.first().l]
    panel = panel_of(rows.select(F.posexplode("l").alias("place", "x")).select("place", F.explode("x.sketch").alias("hash")), distinct=True)
    if panel is None:
        raise ValueError("hashes of a panel are longs or 16 hex digits")
    return panel, ids


def pairs_local(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """The same without a shuffle, for a small panel: its index travels with every task, each read asks it in its row. Stateless, so it also streams."""
    panel, ids = small_panel(refs.select("id", F.col("id").alias("ord"), "sketch"))
    spark, kind = reads.sparkSession, refs.schema["id"].dataType.simpleString()
    named = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"place long, ref_id {kind}"))
    found = reads.select(F.col("id").alias("read_id"), asks(spark, panel)(F.col("sketch")).alias("a")).select("read_id", F.explode("a.l").alias("x"))
    return found.select("read_id", "x.place", "x.shared").join(named, "place").select("read_id", "ref_id", "shared")


def all_counts(refs: DataFrame, found: DataFrame) -> DataFrame:
    """(read_id, counts): each read's shared hashes with every reference of ``refs(id, ord)``, zeros too, in order of ``ord``."""
    names = F.broadcast(refs.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda r: r["id"]).alias("names")))
    known = F.map_from_entries(F.filter(F.collect_list(F.when(F.col("ref_id").isNotNull(), F.struct("ref_id", "shared"))), lambda x: x.isNotNull()))
    listed = found.groupBy("read_id").agg(known.alias("known")).join(names, how="cross")  # one row
    return listed.select("read_id", F.transform("names", lambda r: F.coalesce(F.try_element_at("known", r), F.lit(0).cast("long"))).alias("counts"))


def with_sizes(p: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs with both sketch sizes, Jaccard index and containment of the reference in the read."""
    out = p.join(refs.select(F.col("id").alias("ref_id"), F.size("sketch").alias("ref_size")), "ref_id")
    return out.withColumns({"jaccard": F.col("shared") / (F.col("read_size") + F.col("ref_size") - F.col("shared")), "containment": F.col("shared") / F.col("ref_size"), "union_size": F.least("read_size", "ref_size")})


def inverted_index(refs: DataFrame) -> DataFrame:
    """(hash, refs): which references hold a hash, ascending."""
    return long_form(refs).groupBy("hash").agg(F.sort_array(F.collect_set("id")).alias("refs"))


def verdicts(refs: DataFrame, p: DataFrame, start: int = -1, last_wins: bool = False, min_matches: int = -1, min_diff: int = 0, depth_limit: int | None = None) -> DataFrame:
    """(read_id, ref_id, shared, sketch_size, diff_prefix, diff_runner_up, fail_depth, fail_matches, fail_diff) for every read of ``hits``.

    ``ord`` is the order of ``refs``, of any type (their names: ties go by name). The best reference is the first (``last_wins``: the last) with the most shared hashes. With ``start``
    -1 a read that shares nothing gets the first reference, with 0 none. ``diff_prefix`` is the best less the most among earlier
    references (``start`` if there are none), ``diff_runner_up`` the best less the second best. ``depth_limit``: sketches up to
    this size fail (``min_matches`` if not given); a best below ``min_matches`` fails; a prefix difference up to ``min_diff`` fails.
    """
    order = refs.select(F.col("id").alias("ref_id"), "ord")
    ends_at = refs.agg(F.min("ord").alias("low"), (F.max_by if last_wins else F.min_by)("id", "ord").alias("id")).first()
    named = p.join(F.broadcast(order) if order.count() <= FEW else order, "ref_id", "left")
    listed = named.groupBy("read_id").agg(F.max("read_size").alias("sketch_size"), F.collect_list(F.when(F.col("ref_id").isNotNull(), F.struct("ord", "shared", "ref_id"))).alias("l"))
    l = F.col("l")  # noqa: E741
    most = F.array_max(F.transform(l, lambda x: x["shared"]))
    ends = F.transform(F.filter(l, lambda x: x["shared"] == F.col("best")), lambda x: F.struct(x["ord"].alias("ord"), x["ref_id"].alias("ref_id")))
    top = listed.withColumn("best", most).withColumn("at", F.array_max(ends) if last_wins else F.array_min(ends))
    earlier = F.coalesce(F.array_max(F.transform(F.filter(l, lambda x: x["ord"] < F.col("at.ord")), lambda x: x["shared"])), F.lit(0))
    rest = F.coalesce(F.array_max(F.transform(F.filter(l, lambda x: x["ord"] != F.col("at.ord")), lambda x: x["shared"])), F.lit(0))
    top = top.select("read_id", "sketch_size", F.col("at.ref_id").alias("hit"), F.col("best"), F.when(F.col("at.ord") == F.lit(ends_at.low), F.lit(start)).when(F.col("at.ord").isNotNull(), F.greatest(F.lit(start), earlier)).alias("prev"), rest.alias("second"))
    zero: Column = F.lit(ends_at.id if start < 0 else None)
    best = F.coalesce("best", F.lit(0))
    diff = F.coalesce(F.col("best") - F.col("prev"), F.lit(0 - start)).cast("long")
    limit = min_matches if depth_limit is None else depth_limit
    return top.select(
        "read_id", F.coalesce("hit", zero).alias("ref_id"), best.cast("long").alias("shared"), "sketch_size", diff.alias("diff_prefix"), (best - F.coalesce("second", F.lit(0))).cast("long").alias("diff_runner_up"),
        (F.col("sketch_size") <= limit).alias("fail_depth"), (best < min_matches).alias("fail_matches"), (diff <= min_diff).alias("fail_diff"),
    )


#: Classes that share a hash are paired by a join up to this number (so no class is in more pairs a hash), and beyond it compared in tiles of so many.
LIGHT, TILE = 32, 1024


def _partners(least: int) -> Callable[[pa.Table], pa.Table]:
    """Work on one pair of tiles of the classes that hold ``key``: (class_id, links) found there. A pair counts at the smallest rare key it shares, so once in all."""

    def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, owners = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(values, kind="stable")
        return values[order], owners[order]

    def shared(values: np.ndarray, owners: np.ndarray, n: int, wanted: np.ndarray) -> np.ndarray:
        """How many of ``wanted`` each of n lists holds."""
        at = np.searchsorted(values, wanted)
        m = np.searchsorted(values, wanted, "right") - at
        places = np.arange(m.sum()) + np.repeat(at - np.cumsum(m) + m, m)
        return np.bincount(owners[places], minlength=n)

    def work(group: pa.Table) -> pa.Table:
        key, ids = group["key"][0].as_py(), group["class_id"].to_numpy()
        sketches, rare = (list(map(np.asarray, group[c].to_pylist())) for c in ("sketch", "rare"))
        first = group["tile"].to_numpy() == group["low"][0].as_py()
        within = group["low"][0].as_py() == group["high"][0].as_py()
        left, right = np.flatnonzero(first), np.flatnonzero(first if within else ~first)
        links = np.zeros(len(ids), np.int64)
        if len(left) and len(right):
            met, whole = flat([rare[j][rare[j] < key] for j in right]), flat([sketches[j] for j in right])
            for k, i in enumerate(left.tolist()):
                near = (shared(*whole, len(right), sketches[i]) >= least) & (shared(*met, len(right), rare[i][rare[i] < key]) == 0)
                if within:
                    near[: k + 1] = False
                links[i] += near.sum()
                links[right[near]] += 1
        some = links > 0
        return pa.table({"class_id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64())})

    return work


def near_classes(sk: DataFrame, least: int) -> DataFrame:
    """(id, class_id, links) of ``sk(id, sketch)``: the smallest id of an equal sketch, and how many other classes share ``least`` hashes or more.

    Equal sketches fold into one class first, so copies are never paired. Two sketches that share ``least`` hashes share one
    of their rarest size - least + 1 (prefix filter, exact), so only classes with such a hash in common meet, and count at the smallest
    one. Up to ``LIGHT`` classes of a hash are joined; more are compared in tiles of ``TILE``, and every pair of tiles returns counts, not pairs: no hash
    is left out, and one that very many classes hold is many tasks. Hashes are compared as longs. Null and empty sketches are a class of their own without links.
    """
    keyed = durable(sk.select("id", "sketch", F.sha2(F.coalesce(F.array_join("sketch", ","), F.lit("")), 256).alias("key")))
    classes = durable(keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.first("sketch").alias("sketch")))
    held = durable(classes.filter(F.size("sketch") >= least).select("class_id", F.transform("sketch", lambda h: F.xxhash64(h)).alias("sketch")))
    long = held.select("class_id", F.size("sketch").alias("m"), F.explode("sketch").alias("hash"))
    ranked = long.join(long.groupBy("hash").agg(F.count("*").alias("n")), "hash").groupBy("class_id", "m").agg(F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("l"))
    rare = durable(ranked.select("class_id", F.transform(F.slice("l", F.lit(1), F.col("m") - least + 1), lambda x: x["hash"]).alias("rare")))
    met = rare.select("class_id", "rare", F.explode("rare").alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = durable(met.join(sizes, "key"))
    light = met.filter(F.col("n") <= LIGHT)
    a, b = (light.select("key", F.col("class_id").alias(x), F.col("rare").alias(f"r{x}")) for x in "ab")
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.array_min(F.array_intersect("ra", "rb")) == F.col("key"))).select("a", "b")
    both = pairs.join(held.select(F.col("class_id").alias("a"), F.col("sketch").alias("x")), "a").join(held.select(F.col("class_id").alias("b"), F.col("sketch").alias("y")), "b")
    near = both.filter(F.size(F.array_intersect("x", "y")) >= least).select(F.explode(F.array("a", "b")).alias("class_id"), F.lit(1).cast("long").alias("links"))
    dealt = met.filter(F.col("n") > LIGHT).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    dealt = dealt.withColumns({"tile": F.pmod(F.xxhash64("class_id"), "tiles").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))})
    dealt = dealt.select("class_id", "rare", "key", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")).join(held, "class_id")
    near = near.unionByName(dealt.groupBy("key", "low", "high").applyInArrow(_partners(least), "class_id long, links long"))
    near = near.groupBy("class_id").agg(F.sum("links").alias("links"))
    counted = classes.select("key", "class_id").join(near, "class_id", "left")
    return keyed.select("id", "key").join(counted, "key").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
