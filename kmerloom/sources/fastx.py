"""FASTA and FASTQ readers, k-mer lists, sketch documents."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, ord long, name string, comment string, seq string, qual string"


def parse(lines: Iterable[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, sequence, quality) records. A quality runs until it is as long as its sequence, so it may hold any mark; a cut one ends the file."""
    header, letters, quality = None, [], None
    need = got = 0
    for line in lines:
        line = line.rstrip("\r\n")
        if quality is not None:
            quality.append(line)
            got += len(line)
            if got >= need:
                if got > need:
                    return
                yield _record(header, letters, "".join(quality))
                header, letters, quality = None, [], None
        elif line[:1] in (">", "@"):
            if header is not None:
                yield _record(header, letters, None)
            header, letters = line[1:], []
        elif line[:1] == "+" and header is not None:
            need, got, quality = sum(map(len, letters)), 0, []
            if not need:
                yield _record(header, letters, "")
                header, letters, quality = None, [], None
        elif header is not None:
            letters.append("".join(line.split()))
    if header is not None and quality is None:
        yield _record(header, letters, None)


def _record(header: str, letters: list[str], quality: str | None) -> tuple[str, str, str, str | None]:
    name, _, comment = header.partition(" ") if "\t" not in header.split(" ")[0] else header.partition("\t")
    return name, comment.strip(), "".join(letters).upper(), quality


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("path", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("comment", pa.string()), ("seq", pa.string()), ("qual", pa.string())]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            rows: list[tuple] = []
            for i, record in enumerate(parse(data.decode("utf-8", "replace").splitlines())):
                rows.append((path, i, *record))
                if len(rows) == 1000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def read_fastx(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ord, name, comment, seq, qual) of FASTA and FASTQ files, plain or gzip, one task a file; names may repeat.

    Spark fetches the bytes, so any store it knows will do. A plain FASTA file too large for one task is split by ``read_fasta``.
    """
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_parse_files, SCHEMA)


def stream_fastx(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream over the files that arrive in ``folder``."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return source.select("path", "content").mapInArrow(_parse_files, SCHEMA)


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, comment, seq) of plain FASTA files of any size: Spark splits a file at its records."""
    raw = spark.read.option("lineSep", "\n>").text(paths).filter(F.length(F.trim("value")) > 0)
    header = F.regexp_replace(F.split("value", "\r?\n").getItem(0), "^>", "")
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", ""))
    return raw.select(F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("comment"), body.alias("seq"))


def read_kmer_list(spark: SparkSession, path: str) -> DataFrame:
    """(kmer): the first space-separated token of each line, upper-cased."""
    return spark.read.text(path).select(F.upper(F.split_part("value", F.lit(" "), F.lit(1))).alias("kmer")).filter("kmer <> ''")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """(name, sketch) of sketch documents as ``sketch_json`` writes them, one a line."""
    doc = F.from_json("value", "name string, kmer int, sketchSize int, hashes array<string>")
    return spark.read.text(path).select(doc.alias("d")).select(F.col("d.name").alias("name"), F.col("d.hashes").alias("sketch"))


def read_sketch_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, sketch, ...) as sinks.write_sketches writes it: prepared sketches for the commands."""
    return spark.read.parquet(path)


def read_sketch_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq_length, canonical, hash_type, sketch) of full sketch documents, one a line."""
    doc = F.from_json("value", "name string, seqLen long, canonical string, hashType string, sketches struct<hashes:array<string>>")
    return spark.read.text(path).select(doc.alias("d")).select("d.name", F.col("d.seqLen").alias("seq_length"), (F.col("d.canonical") == "true").alias("canonical"), F.col("d.hashType").alias("hash_type"), F.col("d.sketches.hashes").alias("sketch"))


def read_depths(spark: SparkSession, path: str) -> DataFrame:
    """(hash, depth) of a depth table written as Parquet: prepared depths for the commands."""
    return spark.read.parquet(path).select("hash", "depth")


def parse_mixtures(text: str) -> list[tuple[int, str, float, int, str]]:
    """(mixture, strain, proportion, coverage, path) of a mixture design: tab-separated rows, '#' begins a comment, an empty line ends a mixture."""
    out, mixture, open_ = [], 0, False
    for line in text.splitlines():
        if line.startswith("#"):
            continue
        cells = line.strip().split("\t")
        if len(cells) < 4:
            mixture, open_ = mixture + open_, False
            continue
        out.append((mixture, cells[0], float(cells[1]), int(float(cells[2])), cells[3]))
        open_ = True
    return out


def read_mixtures(spark: SparkSession, path: str) -> list[tuple[int, str, float, int, str]]:
    """A mixture design from a file of any store (it is as long as the design, not the data)."""
    return [row for r in spark.read.text(path, wholetext=True).collect() for row in parse_mixtures(r.value)]


def mixture_files(spark: SparkSession, spec: list[tuple[int, str, float, int, str]]) -> DataFrame:
    """The reads of a design's files with ``strain`` and ``id``, ready for mixture_reads."""
    strains = {path: strain for _, strain, _, _, path in spec}
    one = [read_fastx(spark, path).withColumn("strain", F.lit(strain)) for path, strain in strains.items()]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    return out.withColumn("id", F.concat_ws("#", "path", F.col("ord").cast("string")))
