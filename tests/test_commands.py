"""Strands, hashes, masks and prepared inputs through the commands; lineages and their scores; text forms."""

import json
import random

from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators import lineage as L
from kmerloom.operators import scoring
from kmerloom.operators import sketch as S
from kmerloom.operators import variants as V
from kmerloom.plans import commands as C
from kmerloom.sources import fastx, sinks
from kmerloom.streaming.classify import classify_stream, running_depth, running_prevalence

FLIP = str.maketrans("ACGT", "TGCA")


def flipped(s):
    return s.translate(FLIP)[::-1]


def genomes(seed=5, n=3, size=600):
    rng = random.Random(seed)
    return ["".join(rng.choices("ACGT", k=size)) for _ in range(n)]


def panel(spark, found):
    return spark.createDataFrame([(i, i, s) for i, s in enumerate(found)], "id long, ord long, seq string")


def test_either_strand_by_every_hash(spark):
    """A read of either strand lands on its genome with all its hashes; without both strands the other one shares none."""
    g = genomes()
    reads = spark.createDataFrame([(i, (s if i % 2 else flipped(s))[100:300]) for i, s in enumerate(g)], "id long, seq string")
    for name in K.HASHES:
        got = {r.read_id: (r.ref_id, r.shared, r.sketch_size) for r in C.classify(reads, panel(spark, g), [12], name=name, canonical=True).collect()}
        assert {i: v[0] for i, v in got.items()} == {0: 0, 1: 1, 2: 2} and all(v[1] == v[2] > 180 for v in got.values()), name
        assert C.filter_reads(reads, panel(spark, g), [12], min_matches=10, name=name, canonical=True).count() == 3
    one = {r.read_id: r.shared for r in C.classify(reads, panel(spark, g), [12], name="murmur3").collect()}
    assert one[0] == one[2] == 0 and one[1] > 180
    assert {r.read_id: r.ref_id for r in C.classify(reads, panel(spark, g), [12], **C.DOCUMENTED).collect()} == {0: 0, 1: 1, 2: 2}
    depths = {n: C.count(reads, [12], name=n, canonical=True) for n in K.HASHES}
    assert len({tuple(sorted(r.depth for r in d.collect())) for d in depths.values()}) == 1
    wanted = spark.createDataFrame([(g[0][350:362],)], "kmer string")
    assert C.search(reads, wanted, [12]).count() == 0 and [r.id for r in C.search(reads, wanted, [12], canonical=True).collect()] == [0]


def test_murmur3_lists_equal_single_hashes(spark):
    df = spark.createDataFrame([(1, "ACGTTGCA"), (2, "äöüßabc"), (3, ""), (4, None)], "id long, seq string")
    lists = {r.id: r.h for r in df.select("id", K.hashes(F.col("seq"), [3, 4], "murmur3").alias("h")).collect()}
    for r in df.collect():
        ks = [r.seq[i : i + k] for k in (3, 4) for i in range(len(r.seq or "") - k + 1)]
        assert lists[r.id] == [f"{int(x):016x}" for x in K.murmur3_x64([k.encode() for k in ks])]


def test_masked_letters(spark):
    df = spark.createDataFrame([(1, "ACGTNACGTT"), (2, "NNNNNNN"), (3, None)], "id long, seq string")
    for name in K.HASHES:
        got = {r.id: len(r.sketch) for r in S.sketches(df, [4], None, name, valid_only=True).collect()}
        assert got == {1: 2, 2: 0, 3: 0}
    assert S.hash_table(df, [4], valid_only=True).count() == 3
    assert {r.id: len(r.sketch) for r in S.masked_sketches(df, [4], None, 2, valid_only=True).collect()} == {1: 1, 2: 0, 3: 0}


def test_masks_of_every_kind_agree(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=rng.randint(0, 80)))) for i in range(40)] + [(99, None)], "id long, seq string")
    for canonical in (False, True):
        for name in K.HASHES:
            how = {"name": name, "canonical": canonical}
            own = {r.id: r.sketch for r in S.masked_sketches(df, [5], 20, 3, **how).collect()}
            assert own == {r.id: r.sketch for r in S.masked_sketches(df, [5], 20, 3, depths=S.depth(df, [5], **how), **how).collect()}
            deep = {r.hash for r in S.depth(df, [5], **how).filter("depth >= 3").collect()}
            key = (lambda h: h % 2**64) if name == "xxhash64" else (lambda h: h)
            want = {r.id: sorted({h for h in r.h if h in deep}, key=key)[:20] for r in df.select("id", K.hashes(F.col("seq"), [5], **how).alias("h")).collect()}
            assert own == want
            loose = {r.id: set(r.sketch) for r in S.masked_sketches(df, [5], None, 3, slots=16, **how).collect()}
            tight = {r.id: set(r.sketch) for r in S.masked_sketches(df, [5], None, 3, **how).collect()}
            assert all(tight[i] <= loose[i] for i in tight), "counters of fixed number never count too little"
    exact = {r.hash: r.depth for r in S.depth(df, [5]).collect()}
    slots = {r.slot: r.depth for r in S.slot_depth(df, [5], 64).collect()}
    assert len(slots) <= 64 and all(n <= slots[int(h[:8], 16) % 64] for h, n in exact.items()) and sum(slots.values()) == sum(exact.values())


def test_occurrence_frequency(spark):
    df = spark.createDataFrame([(1, "AAAAAC"), (2, "AAAAAG")], "id long, seq string")
    a = sorted(r.n_refs for r in S.sample_frequency(df, [4]).collect())
    b = sorted(r.n_refs for r in S.sample_frequency(df, [4], mode="occurrence").collect())
    assert a == [1, 1, 2] and b == [1, 1, 4]
    assert {r.id: len(r.sketch) for r in S.max_samples_sketches(df, [4], None, 2, mode="occurrence").collect()} == {1: 1, 2: 1}


def test_pieces_give_the_whole_profile(spark):
    """References cut into small pieces: same places, depths, means and calls as in one piece."""
    rng = random.Random(8)
    refs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate((0, 3, 4, 50, 64, 65, 200, 333))] + [(99, None)], "id long, seq string")
    reads = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=60))) for i in range(60)], "id long, seq string")
    depths = S.depth(reads, [4])
    for window in (1, 7, 40):
        whole = sorted(map(tuple, V.depth_profile(refs, depths, 4, window).collect()))
        assert len(whole) == sum(n - 3 for n in (4, 50, 64, 65, 200, 333))
        for piece in (1, 16, 64):
            assert sorted(map(tuple, V.depth_profile(refs, depths, 4, window, piece).collect())) == whole
        calls = [sorted(map(tuple, V.candidates(V.places(refs, depths, 4, window, piece), 4, extras=True).collect())) for piece in (16, 1 << 16)]
        assert calls[0] == calls[1] and (calls[0] or window == 1), 'a mean of one place is its own depth'


def test_calls_from_either_strand(spark):
    g = genomes(9, 1, 120)[0]
    mutated = g[:60] + ("A" if g[60] != "A" else "C") + g[61:]
    reads = spark.createDataFrame([(i, mutated if i % 2 else flipped(mutated)) for i in range(20)], "id long, seq string")
    for name in ("md5", "murmur3"):
        calls = C.call(panel(spark, [g]), reads, 12, 30, name=name, canonical=True, strict=True).collect()
        assert (61, g[60], mutated[60]) in {(r.pos, r.orig, r.alt) for r in calls}
    prepared = C.call(panel(spark, [g]), None, 12, 30, depths=C.count(reads, [12], canonical=True), canonical=True, strict=True).collect()
    assert sorted(map(tuple, prepared)) == sorted(map(tuple, C.call(panel(spark, [g]), reads, 12, 30, canonical=True, strict=True).collect()))


def test_assignment_without_lineage_keeps_its_sublineage(spark):
    """A lineage below its bound is none, so it can't disagree with the sub-lineage."""
    schema = "read_id long, n_hashes long, type_shared long, lin array<struct<name:string,sim:double,shared:long>>, sublin array<struct<name:string,sim:double,shared:long>>"
    got = L.assign(spark.createDataFrame([(1, 100, 20, [("A", 0.04, 4)], [("A1", 0.04, 4)])], schema)).first()
    assert (got.lineage, got.sublineage) == ("", "A1")


def test_depth_masks_types_and_lineages(spark):
    """One read, every hash of which occurs once: with a depth of 2 it shares nothing with type or lineage, but keeps its number of hashes."""
    a, b = genomes(11, 2)
    names = spark.createDataFrame([("A1", a), ("B1", b)], "name string, seq string")
    reads = spark.createDataFrame([(1, a[100:200])], "id long, seq string")
    plain = C.lineages(reads, panel(spark, [a, b]), names, [12]).first()
    assert plain.type_shared == 89 and [(g.name, g.shared) for g in plain.lin] == [("A", 89)] and plain.n_hashes == 89
    masked = C.lineages(reads, panel(spark, [a, b]), names, [12], min_depth=2).first()
    assert (masked.type_shared, masked.lin, masked.sublin, masked.n_hashes) == (0, [], [], 89)
    twice = C.lineages(reads.unionByName(reads.withColumn("id", F.lit(2).cast("long"))), panel(spark, [a, b]), names, [12], min_depth=2).collect()
    assert all(r.type_shared == 89 and r.sublin[0].name == "A1" for r in twice)
    full = C.lineages(reads, panel(spark, [a, b]), names, [12], full=True, canonical=True).first()
    assert [(g.name, g.shared) for g in full.lin] == [("A", 89), ("B", 0)]


def test_lines_score_as_the_table_does(spark):
    a, b = genomes(12, 2)
    names = spark.createDataFrame([("A1", a), ("B1", b)], "name string, seq string")
    reads = spark.createDataFrame([(i, (a if i < 3 else b)[i * 40 : i * 40 + 150]) for i in range(4)], "id long, seq string")
    found = C.lineages(reads, panel(spark, [a, b]), names, [12])
    lines = C.lineage_lines(found)
    assert all(len(r.line.split("\t")) == 7 for r in lines.collect())
    score = C.score_reads(C.parse_lineage_lines(lines)).first()
    assert score == C.score_reads(found).first()
    assert score.lineages == "A:0.750000;B:0.250000" and score.sublineage_counts == "A1:3;B1:1" and score.lineage_note == "WARN:low_lineage_counts:4"
    empty = C.score_reads(found.limit(0)).first()
    assert (empty.lineages, empty.lineage_note) == ("", "WARN:low_lineage_counts:0")
    named = found.withColumn("read_name", F.concat(F.lit("x|y|A1_"), F.col("read_id").cast("string"))).unionByName(found.withColumn("read_name", F.lit("x|rand|z")))
    assert sorted({r.strain for r in C.projection(named).collect()}) == ["A1"] and C.projection(named).count() == 4


def test_mixtures_and_lines(spark, tmp_path):
    text = "# design\nA\t0.6\t10\t%s\nB\t0.4\t10\t%s\n\nA\t1.0\t5\t%s\n"
    for n in "AB":
        (tmp_path / f"{n}.fq").write_text("".join(f"@{n}{i}\nACGT\n+\nIIII\n" for i in range(200)))
    (tmp_path / "design.tsv").write_text(text % tuple(tmp_path / f"{n}.fq" for n in "ABA"))
    spec = fastx.read_mixtures(spark, str(tmp_path / "design.tsv"))
    assert [row[:4] for row in spec] == [(0, "A", 0.6, 10), (0, "B", 0.4, 10), (1, "A", 1.0, 5)]
    drawn = scoring.mixture_reads(fastx.mixture_files(spark, spec), [row[:4] for row in spec], 2500)
    got = {(r.mixture, r.strain, r.mixture_name): r["count"] for r in drawn.groupBy("mixture", "strain", "mixture_name").count().collect()}
    assert got == {(0, "A", "A-0.6_B-0.4_10"): 60, (0, "B", "A-0.6_B-0.4_10"): 40, (1, "A", "A-1_5"): 50}
    order = [r.id for r in scoring.shuffled(spark.range(100)).collect()]
    assert sorted(order) == list(range(100)) and order != sorted(order) and order == [r.id for r in scoring.shuffled(spark.range(100).repartition(7)).collect()]
    found = spark.createDataFrame([("s1", "A1"), ("s1", None), ("s1", "A2"), ("t", "B1")], "sample string, strain string")
    samples = spark.createDataFrame([("s1", False), ("t", True)], "sample string, coinfected boolean")
    lines = {r.sample: r.line for r in scoring.result_lines(scoring.strain_features(found, ["C1"]), scoring.sample_labels(samples)).collect()}
    assert lines == {"s1": "-1 1.0 'hpv |vir A1:1 A2:1 C1:0 unclassified:1", "t": "1 1.0 'hpv |vir B1:1 C1:0"}
    short = {r.sample: r.line for r in scoring.result_lines(scoring.strain_features(found, collapse=True), scoring.sample_labels(samples), normalize=True).collect()}
    assert short["s1"] == "-1 1.0 'hpv |vir A:0.666667 U:0.333333"


def test_accuracy_and_composition(spark):
    calls = spark.createDataFrame([("A1", "A", 0.2, "A1", 0.1), ("A1", "A", 0.2, "A2", 0.1), ("A1", "B", 0.2, None, None), ("B1", "B", 0.0, "B1", 0.005)], "strain string, lineage string, lin_sim double, sublineage string, sub_sim double")
    got = {r.strain: (r.n, round(r.pct_sublineage, 4), round(r.pct_lineage, 4)) for r in scoring.accuracy_of_lineages(calls).collect()}
    assert got == {"A1": (3, 0.3333, 0.6667), "B1": (1, 1.0, 0.0)}
    assert {r.name: r.pct for r in scoring.composition(calls).collect()} == {"A1": 0.5, "A2": 0.5}


def test_text_forms(spark, tmp_path):
    sk = S.sketches(spark.createDataFrame([(1, "ACGTTGCA"), (2, "TTTTACGT")], "id long, seq string"), [4], 3)
    name = F.concat(F.lit("a|"), F.col("id").cast("string"))
    docs = sk.select(sinks.sketch_document(name, F.lit(8), F.col("sketch"), [4, 5], "murmur3", True).alias("value"))
    docs.write.text(str(tmp_path / "d"))
    one = json.loads(docs.first().value)
    assert list(one) == sorted(one) and one["hashType"] == "MurmurHash3_x64_128" and one["hashSeed"] == 42 and one["canonical"] == "true" and one["kmer"] == "4 5" and one["sketches"]["length"] == 3
    back = {r.name: (r.seq_length, r.canonical, r.sketch) for r in fastx.read_sketch_documents(spark, str(tmp_path / "d")).collect()}
    assert back == {f"a|{r.id}": (8, True, r.sketch) for r in sk.collect()}
    listed = json.loads(sinks.sketch_list(sk, name, F.col("id"), [4], 3).first().json)
    assert [d["name"] for d in listed] == ["a|1", "a|2"] and listed[0]["kmer"] == [4] and listed[0]["sketches"] == sk.filter("id = 1").first().sketch
    line = sk.filter("id = 1").select(sinks.sketch_line(name, F.slice("sketch", 1, 1), F.lit("XYX"), [4], 3).alias("l")).first().l
    assert line.startswith("XYX 1.0 `a_1|vir ") and line.endswith(":1 |sketch k:4 s:3")
    sinks.write_sketches(sk, str(tmp_path / "s"))
    assert sorted(map(tuple, fastx.read_sketch_table(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, sk.collect()))
    v = spark.createDataFrame([("r1", None, 0, 5, True, True, False)], "id string, ref string, shared long, total int, fail_depth boolean, fail_matches boolean, fail_diff boolean")
    said = v.select(sinks.report(F.col("id"), F.col("ref"), F.col("shared"), F.col("total"), sinks.failures(v)).alias("l")).first().l
    assert said == "Sample: r1\tResult: \t0\t5\tFAIL:DEPTH FAIL:MATCHES"
    unique = L.group_unique(spark.createDataFrame([("A", "AAAAC"), ("B", "AAAAG"), (None, "CCCCC")], "g string, seq string"), "g", 4)
    sinks.write_group_hashes(unique, "g", str(tmp_path / "g"))
    assert {r.g: r.value for r in spark.read.option("basePath", str(tmp_path / "g")).text(str(tmp_path / "g")).collect()} == {r.g: r.hash for r in unique.collect() if r.g}
    calls = spark.createDataFrame([("x", 10, "T", "A", 1, 8, 6, 2), ("x", 9, "T", "A", 1, 8, 6, 2)], "ref_id string, pos long, orig string, alt string, kc long, md long, rd long, od long")
    sinks.write_vcf(calls, str(tmp_path / "v"), "x.fa")
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines[:3] == ["##fileformat=VCFv4.2", "##reference=x.fa", "##source=kmerloom"] and [x.split("\t")[1] for x in lines[-2:]] == ["10", "9"], "in order of the key text"


def test_streams_count_as_batches_do(spark, tmp_path):
    g = genomes(13, 2, 200)
    reads = spark.createDataFrame([(i, g[i % 2][i : i + 90]) for i in range(10)], "id long, seq string")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    sk = S.sketches(panel(spark, g), [12]).join(panel(spark, g).select("id", "ord"), "id")
    stream = lambda: spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))

    def rows(df, name):
        run = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert rows(running_depth(stream(), 12, canonical=True), "depths") == sorted(map(tuple, C.count(reads, [12], canonical=True).collect()))
    assert rows(running_prevalence(classify_stream(stream(), sk, [12])), "refs") == [(0, 5), (1, 5)]
    assert rows(running_prevalence(classify_stream(stream(), sk.limit(0), [12])), "none") == [(None, 10)]
