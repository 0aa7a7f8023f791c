"""The user-visible commands, each a plan over sequences (``id``, ``seq``, references also ``ord``).

Every command takes how k-mers are hashed (``name``, ``canonical``, ``valid_only``; see functions/kmers.py) as keywords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kmerloom.cluster import durable
from kmerloom.functions import kmers as K
from kmerloom.functions.arrays import NAMES
from kmerloom.functions.kmers import six
from kmerloom.operators import buckets, stretches
from kmerloom.operators import lineage as L
from kmerloom.operators import overlap as O
from kmerloom.operators import scoring
from kmerloom.operators import sketch as S
from kmerloom.operators import variants as V
from kmerloom.sources import sinks

#: The reference panel's documented hash: both strands by Murmur3, other letters masked.
DOCUMENTED = {"name": "murmur3", "canonical": True, "valid_only": True}


def _how(name: str, canonical: bool, valid_only: bool) -> dict:
    return {"name": name, "canonical": canonical, "valid_only": valid_only}


def classify(
    reads: DataFrame | None, refs: DataFrame, ks: list[int], s: int | None = 1000, min_depth: int = 0, max_samples: int = 0, min_matches: int = -1, min_diff: int = 0, start: int = -1,
    name: str = "md5", canonical: bool = False, valid_only: bool = False, mode: str = "samples", depths: DataFrame | None = None, slots: int | None = None,
    read_sketches: DataFrame | None = None, ref_sketches: DataFrame | None = None, **options,
) -> DataFrame:
    """Each read's best reference with its verdicts. ``min_depth`` masks rare read k-mers, ``max_samples`` common reference k-mers; either pass runs only when asked for.

    Prepared inputs take the place of a pass: ``read_sketches(id, sketch)``, ``ref_sketches(id, sketch)``, ``depths(hash, depth)`` of the
    reads, all hashed the same way. ``slots`` masks by counters of fixed number. Reference sketches are made once.
    """
    how = _how(name, canonical, valid_only)
    if ref_sketches is None:
        ref_sketches = S.max_samples_sketches(refs, ks, s, max_samples, mode=mode, **how) if max_samples else S.sketches(refs, ks, s, **how)
    texts = {"texts": reads, "ks": ks, "s": s, **how} if read_sketches is None and not min_depth and name in NAMES else {}
    if read_sketches is None:
        read_sketches = S.masked_sketches(reads, ks, s, min_depth, depths=depths, slots=slots, **how) if min_depth else S.sketches(reads, ks, s, **how)
    panel = durable(ref_sketches.join(refs.select("id", "ord"), "id"))
    return O.verdicts(panel, O.hits(read_sketches, panel, **texts), start, min_matches=min_matches, min_diff=min_diff, **options)


def filter_reads(reads: DataFrame, refs: DataFrame, ks: list[int], s: int | None = 1000, inverse: bool = False, **options) -> DataFrame:
    """The reads that pass depth, matches and diff (``inverse``: those that don't). A read that shares nothing fails; an empty sketch fails depth."""
    options = {"start": 0, "depth_limit": 0} | options
    v = classify(reads, refs, ks, s, **options).withColumnRenamed("read_id", "id")
    passed = ~(F.col("fail_depth") | F.col("fail_matches") | F.col("fail_diff"))
    return reads.join(v.filter(~passed if inverse else passed).select("id", "ref_id", "shared"), "id")


def hash_dump(seqs: DataFrame, ks: list[int], as_kmers: bool = False, **how) -> DataFrame:
    """(id, line): all k-mers or hashes of a sequence, tab-separated, in order."""
    listed = K.kmers_multi(F.col("seq"), ks) if as_kmers else K.hashes(F.col("seq"), ks, **how)
    return seqs.select("id", F.array_join(listed.cast("array<string>"), "\t").alias("line"))


def count(seqs: DataFrame, ks: list[int], slots: int | None = None, least: int = 1, **how) -> DataFrame:
    """(hash, depth), or with ``slots`` (slot, depth) of counters of fixed number; those of ``least`` or more."""
    return S.slot_depth(seqs, ks, slots, **how).filter(F.col("depth") >= least) if slots else S.depth(seqs, ks, least, **how)


def search(seqs: DataFrame, wanted: DataFrame, ks: list[int], canonical: bool = False) -> DataFrame:
    return S.search(seqs, wanted, ks, canonical)


def call(refs: DataFrame, reads: DataFrame | None, k: int, window: int = 100, show_depth: bool = False, depths: DataFrame | None = None, name: str = "md5", canonical: bool = False, valid_only: bool = False, **options) -> DataFrame:
    """Variants, or with ``show_depth`` the depth profile they are called from."""
    how = _how(name, canonical, valid_only)
    depths = S.depth(reads, [k], **how) if depths is None else depths
    if show_depth:
        return V.depth_profile(refs, depths, k, window, **how)
    return V.call(refs, None, k, window, depths, **how, **options)


def _best_types(reads: DataFrame, types: DataFrame, ks: list[int], min_depth: int, **how) -> DataFrame:
    """``classify`` on full hash sets; of few types only their own hashes are counted, and rare ones leave the types' side (so ``sketch_size`` counts them)."""
    if not min_depth or how.get("name", "md5") not in NAMES:
        return classify(reads, types, ks, None, min_depth, **how)
    long = durable(S.long_form(S.sketches(types, ks, None, **how)))
    asked = long.select("hash").distinct()
    if asked.count() > O.FEW:
        return classify(reads, types, ks, None, min_depth, **how)
    deep = buckets.depth_among(reads, ks, asked, **how).filter(F.col("depth") >= min_depth)
    name = how.get("name", "md5")
    return classify(reads, types, ks, None, ref_sketches=S.all_ids(types, S.gathered(long.join(deep, "hash", "left_semi"), None, name), name), **how)


def lineages(reads: DataFrame, types: DataFrame, panel: DataFrame | None, ks: list[int], min_depth: int = 0, full: bool = False, **how) -> DataFrame:
    """(read_id, n_hashes, type_id, type_shared, lin, sublin): best type on full hash sets, then ranked lineages and sub-lineages by their own hashes.

    Lineage and sub-lineage are the first one and two characters of the panel's names. Reads use every k, panel and types the first one.
    ``min_depth`` masks a read's rare hashes for type, lineage and sub-lineage alike; ``n_hashes`` counts them too. ``full`` lists groups without a
    shared hash as well. Without ``panel`` the reads, which then have a ``name``, are their own panel.
    """
    k, alone = ks[:1], panel is None
    panel = reads if alone else panel
    best = None
    levels = (("lin", 1), ("sublin", 2))
    arrays = how.get("name", "md5") in NAMES
    if arrays:  # both levels in one pass
        named = panel.select(*(["id"] if alone else []), "seq", *(L.lineage_of(F.col("name"), n).alias(level) for level, n in levels))
        names = [[r[0] for r in named.select(level).filter(F.col(level).isNotNull()).distinct().orderBy(level).limit(L.GROUPS + 1).collect()] for level, _ in levels]
        arrays = max(map(len, names)) <= L.GROUPS
    if arrays:
        tables = [reads.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(n)], f"place long, {level} string") for n, (level, _) in zip(names, levels)]
        for column, t, (level, _) in zip("ab", tables, levels):
            named = named.join(F.broadcast(t), level, "left").withColumn(column, F.coalesce("place", F.lit(0))).drop("place", level)
        size = tuple(map(len, names))
        if len(ks) == 1 and ks[0] >= stretches.LEAST and isinstance(reads.schema["id"].dataType, IntegralType):
            names = [r[0] for r in types.select("id").filter("id IS NOT NULL").distinct().orderBy("id").limit(O.FEW + 1).collect()]
            met = len(names) <= O.FEW and not reads.filter("id IS NULL").limit(1).count()  # then types are counted where the k-mers meet, too
            numbered = reads.sparkSession.createDataFrame(list(enumerate(names, 1)), f"place long, ref_id {types.schema['id'].dataType.simpleString()}")
            asked = types.select(F.col("id").alias("ref_id"), "seq").join(F.broadcast(numbered), "ref_id") if met else None
            own = durable(stretches.group_counts(named if alone else reads, ks[0], size, None if alone else named, min_depth, asked, **how))
            if met:
                hits = own.filter("level = 2").join(F.broadcast(numbered), "place").select(F.col("id").alias("read_id"), "ref_id", "shared")
                best = O.verdicts(types.select("id", "ord"), reads.select(F.col("id").alias("read_id"), F.lit(0).alias("read_size")).distinct().join(hits, "read_id", "left"))
        else:
            own = durable(buckets.group_counts(reads, ks, named, size, k, min_depth, **how))
        sizes = L.read_sizes(reads, ks)
    else:
        deep = durable(S.depth(reads, ks, min_depth, **how).select("hash")) if min_depth else None
    best = _best_types(reads, types, k, min_depth, **how) if best is None else best
    out = best.select("read_id", F.col("ref_id").alias("type_id"), F.col("shared").alias("type_shared"))
    out = out.join(L.read_sizes(reads, ks).withColumnRenamed("id", "read_id"), "read_id", "left")
    empty = F.expr("cast(array() as array<struct<name:string,sim:double,shared:bigint>>)")
    for i, (level, letters) in enumerate(levels):
        named = panel.withColumn(level, L.lineage_of(F.col("name"), letters))
        if arrays:
            overlap = L.ranked(own.filter(F.col("level") == i).join(F.broadcast(tables[i]), "place").select("id", level, "shared"), sizes, level)
        else:
            overlap = L.group_overlap(reads, ks, L.group_unique(named, level, k, **how), level, deep=deep, **how)
        lists = L.ranked_lists(overlap, level).select("read_id", F.col("groups").alias(level))
        out = out.join(lists, "read_id", "left").withColumn(level, F.coalesce(level, empty))
        out = L.with_zeros(out, level, named, level) if full else out
    return out.withColumn("n_hashes", F.coalesce("n_hashes", F.lit(0)))


def lineage_lines(found: DataFrame) -> DataFrame:
    """(line): read, type, shared/hashes, lineages with similarities, sub-lineages with similarities, and both lists' shared hashes, tab-separated."""
    sims = lambda c: F.array_join(F.transform(c, lambda g: F.concat(g["name"], F.lit(":"), six(g["sim"]), F.lit(";"))), "")
    counts = lambda c: F.array_join(F.transform(c, lambda g: F.concat(g["shared"].cast("string"), F.lit(";"))), "")
    cells = [F.col("read_id").cast("string"), F.coalesce(F.col("type_id").cast("string"), F.lit("")), K.ratio_text(F.col("type_shared"), F.col("n_hashes")), sims("lin"), sims("sublin"), counts("lin"), counts("sublin")]
    return found.select(F.concat_ws("\t", *cells).alias("line"))


def parse_lineage_lines(lines: DataFrame) -> DataFrame:
    """``lineages``' table from its lines (column ``line``), so that written results can be scored."""
    cell = lambda i: F.split_part("line", F.lit("\t"), F.lit(i))

    def listed(sims: int, counts: int):
        part = lambda i: F.filter(F.split(cell(i), ";"), lambda x: x != "")
        return F.zip_with(part(sims), part(counts), lambda a, b: F.struct(F.split_part(a, F.lit(":"), F.lit(1)).alias("name"), F.split_part(a, F.lit(":"), F.lit(2)).cast("double").alias("sim"), b.cast("long").alias("shared")))

    ratio = lambda i: F.split_part(cell(3), F.lit("/"), F.lit(i)).cast("long")
    return lines.select(cell(1).alias("read_id"), cell(2).alias("type_id"), ratio(1).alias("type_shared"), ratio(2).alias("n_hashes"), listed(4, 6).alias("lin"), listed(5, 7).alias("sublin"))


def score_reads(found: DataFrame, min_hashes: int = 50, min_type_match: int = 15) -> DataFrame:
    """One row on a whole sample: reads of ``lineages`` are checked, assigned and counted (lineages, sublineages, sublineage_counts, two notes)."""
    return L.summary(durable(L.assign(found, min_hashes, min_type_match)))


def projection(found: DataFrame, name: str = "read_name") -> DataFrame:
    """(strain, lineage, sublineage) a read: the strain from its name (third part between bars, up to an underscore), the first of either list with its similarity; reads of random origin are left out."""
    strain = F.split_part(F.split_part(name, F.lit("|"), F.lit(3)), F.lit("_"), F.lit(1))
    first = lambda c: F.array_join(F.transform(F.slice(c, 1, 1), lambda g: F.concat(g["name"], F.lit(":"), six(g["sim"]))), "")
    return found.filter(~F.col(name).contains("rand")).select(strain.alias("strain"), first("lin").alias("lineage"), first("sublin").alias("sublineage"))


def classification_lines(v: DataFrame) -> DataFrame:
    """(line): reference, read, shared, sketch size and FAIL marks, tab-separated."""
    return v.select(F.concat_ws("\t", F.coalesce(F.col("ref_id").cast("string"), F.lit("")), F.col("read_id").cast("string"), F.col("shared").cast("string"), F.col("sketch_size").cast("string"), sinks.failures(v)).alias("line"))


def mixture_reads(reads: DataFrame, spec: list[tuple[int, str, float, int]], genome_length: float, strain: str = "strain", seed: int = 42) -> DataFrame:
    """``reads`` drawn for every mixture of ``spec`` (mixture, strain, proportion, coverage), with ``mixture`` and ``mixture_name``; see sources.read_mixtures."""
    return scoring.mixture_reads(reads, spec, genome_length, strain, seed)
