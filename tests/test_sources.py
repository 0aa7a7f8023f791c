import gzip

from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.operators import sketch as S
from kmerloom.plans import commands as C
from kmerloom.sources import fastx, sinks

FASTQ = "@r1 first read\nacgt\nAC\n+\n@>+II\nI\n@r2\tx\nTTTT\n+r2\nIIII\n"


def test_parse():
    assert list(fastx.parse(FASTQ.splitlines())) == [("r1", "first read", "ACGTAC", "@>+III"), ("r2", "x", "TTTT", "IIII")]
    assert list(fastx.parse(">a\r\nAC GT\r\n\r\n>b c d\r\nGG".splitlines())) == [("a", "", "ACGT", None), ("b", "c d", "GG", None)]
    assert list(fastx.parse("@r\nACGT\n+\nII\n".splitlines())) == [], "a cut quality ends the file"
    assert list(fastx.parse([])) == [] and list(fastx.parse(["noise"])) == []


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fq").write_text(FASTQ)
    (tmp_path / "in/b.fa.gz").write_bytes(gzip.compress(b">a one\nACGT\n>a two\nGGGG\n"))
    rows = fastx.read_fastx(spark, str(tmp_path / "in")).collect()
    assert sorted((r.name, r.ord, r.seq, r.qual) for r in rows) == [("a", 0, "ACGT", None), ("a", 1, "GGGG", None), ("r1", 0, "ACGTAC", "@>+III"), ("r2", 1, "TTTT", "IIII")]
    (tmp_path / "big.fa").write_text("".join(f">s{i} c\nACGT\nAC{'GT' * i}\n" for i in range(50)))
    got = {r.name: (r.comment, r.seq) for r in fastx.read_fasta(spark, str(tmp_path / "big.fa")).collect()}
    assert got == {f"s{i}": ("c", "ACGTAC" + "GT" * i) for i in range(50)}
    (tmp_path / "k.txt").write_text("acgt x\n\nTTTT\n")
    assert [r.kmer for r in fastx.read_kmer_list(spark, str(tmp_path / "k.txt")).collect()] == ["ACGT", "TTTT"]
    stream = fastx.stream_fastx(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("fx").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("fx").count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", "ACGT", "IIII"), ("r2", "AC", None)], "name string, seq string, qual string")
    text = [r[0] for r in df.select(sinks.fastq(F.col("name"), F.col("seq"), F.col("qual"))).collect()]
    assert text == ["@r1\nACGT\n+\nIIII", ">r2\nAC"]
    calls = spark.createDataFrame([("x", 5, "T", "A", 1, 8, 6, 2)], "ref_id string, pos long, orig string, alt string, kc long, md long, rd long, od long")
    sinks.write_vcf(calls, str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[-1] == "x\t5\t.\tT\tA\t99\tPASS\tKC=1;MD=8;RD=6;OD=2"
    sk = S.sketches(spark.createDataFrame([(1, "ACGTTGCA")], "id long, seq string"), [4], 3)
    docs = sk.select(sinks.sketch_json(F.lit("a|b"), F.col("sketch"), 4).alias("value"))
    docs.write.text(str(tmp_path / "j"))
    back = fastx.read_sketches(spark, str(tmp_path / "j")).first()
    assert back.name == "a|b" and back.sketch == sk.first().sketch
    assert sinks.json_features(docs.union(docs), collapse=True).first().line.count(":2") == 3
    sinks.write_tsv(calls, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t").count() == 1


def test_commands_on_made_genomes(spark):
    """Reads of a made genome land on it; a mutated panel is told apart by its own k-mers."""
    import random

    rng = random.Random(5)
    genomes = {n: "".join(rng.choices("ACGT", k=600)) for n in ("zika", "dengue", "yellow")}
    refs = spark.createDataFrame([(i, i, n, s) for i, (n, s) in enumerate(genomes.items())], "id long, ord int, name string, seq string")
    rows = [(100 + i, s[j : j + 150]) for i, (n, s) in enumerate(genomes.items()) for j in (0, 200)][:6]
    reads = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "id long, seq string")
    got = {r.read_id: r.ref_id for r in C.classify(reads, refs, [12]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}
    assert C.filter_reads(reads, refs, [12], min_matches=10).count() == 6
    panel = spark.createDataFrame([(1, "A1", genomes["zika"]), (2, "A2", genomes["zika"][:300] + genomes["yellow"][:300]), (3, "B1", genomes["dengue"])], "id long, name string, seq string")
    found = {r.read_id: r for r in C.lineages(reads, refs, panel, [12]).collect()}
    assert found[0].lin[0].name == "A" and found[2].lin[0].name == "B" and found[2].type_shared > 100
    assert C.hash_dump(reads, [12]).count() == 6 and C.count(reads, [12]).count() > 100
    assert C.search(reads, spark.createDataFrame([(genomes["zika"][3:15],)], "kmer string"), [12]).first().id == 0
    assert K.is_valid is not None and C.call(refs, reads, 12).count() >= 0
