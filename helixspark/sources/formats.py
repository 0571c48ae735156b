"""Readers and writers. Malformed rows are errors or, where the format is known for them, dropped; see each function."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.alignment import parsed_pile


# -- FASTA


def fasta(spark: SparkSession, path: str, header: str = "name", duplicates: str = "keep") -> DataFrame:
    """name, seq. header: name (up to the first space) or full. duplicates: keep, or error if a name is there twice.

    Records are split by the reader itself, so a file of many records is read by many tasks.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), "^>", "").alias("r")).filter(F.trim("r") != "")
    return _fasta_records(raw, header, duplicates)


def _fasta_records(raw: DataFrame, header: str, duplicates: str) -> DataFrame:
    head, body = F.substring_index("r", "\n", 1), F.when(F.contains("r", F.lit("\n")), F.expr("substring(r, instr(r, '\n') + 1)")).otherwise("")
    name = F.substring_index(head, " ", 1) if header == "name" else head
    found = raw.select(name.alias("name"), dna.strip_newlines(body).alias("seq"))
    if duplicates == "error":
        twice = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("name").alias("twice"))
        found = found.join(twice, found["name"] == twice["twice"], "left").select(dna.require(F.col("twice").isNull(), F.col("name"), "a name is there twice").alias("name"), "seq")
    return found


def fasta_from_string(df: DataFrame, text: str, header: str = "name") -> DataFrame:
    """name, seq of the records in a column of FASTA texts."""
    parts = F.split(F.regexp_replace(F.replace(F.col(text), F.lit("\r"), F.lit("")), "^>", ""), "\n>")
    return _fasta_records(df.select(F.explode(parts).alias("r")).filter(F.trim("r") != ""), header, "keep")


def fasta_lines(genome: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return genome.select(name, F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), dna.wrap(seq)).alias("value"))


def write_fasta(genome: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    """Records in the order of their names, over as many files as the order's ranges."""
    fasta_lines(genome, name, seq).orderBy(name).select("value").write.text(path)


# -- annotations


def sgd_features(lines: DataFrame, value: str = "value") -> DataFrame:
    """chr, l, r, description, type, fwd, gene, sys_name, id of tab lines; lines that can't be read are dropped."""
    c = F.split(value, "\t")
    at = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
    a, b, n = at(9).try_cast("int"), at(10).try_cast("int"), F.size(c)
    gene = F.when(F.startswith(at(6), F.lit("chromosome")), F.when(at(4) != "", at(4)).otherwise(at(3))).otherwise(at(6))
    found = lines.select(
        n.alias("__n"), at(8).try_cast("int").alias("chr"), F.least(a, b).alias("l"), F.greatest(a, b).alias("r"), F.trim(F.concat(gene, F.lit("/"), at(4), F.lit("/"), at(15), F.lit("/"))).alias("description"), at(1).alias("type"),
        F.when(at(11) == "W", True).when(at(11) == "C", False).otherwise(a <= b).alias("fwd"), F.upper(gene).alias("gene"), F.upper(F.when(at(3) != "", at(3)).otherwise(at(6))).alias("sys_name"), at(0).alias("id"),
    )
    return found.filter("__n >= 12 AND chr IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL").drop("__n")


def read_sgd(spark: SparkSession, path: str) -> DataFrame:
    return sgd_features(spark.read.text(path)).orderBy("chr", "l", "r", "id")


def sgd_line() -> Column:
    """A feature as sixteen tab columns; ends are exchanged on the minus strand."""
    a, b = F.when(F.col("fwd"), F.col("l")).otherwise(F.col("r")), F.when(F.col("fwd"), F.col("r")).otherwise(F.col("l"))
    none = F.lit("")
    return F.concat_ws("\t", "id", "type", none, "sys_name", "gene", none, F.concat(F.lit("chromosome "), F.col("chr").cast("string")), none, F.col("chr").cast("string"), a.cast("string"), b.cast("string"), F.when(F.col("fwd"), "W").otherwise("C"), none, F.lit("2000-01-01"), F.lit("2000-01-01"), "description")


def genome_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Genome and features of folder/name.fsa and folder/name_features.tab, name being the folder's."""
    name = folder.rstrip("/").rpartition("/")[2]
    return fasta(spark, f"{folder}/{name}.fsa"), read_sgd(spark, f"{folder}/{name}_features.tab")


def write_lines(df: DataFrame, path: str, *order: str, line: str = "line") -> None:
    df.orderBy(*order).select(F.col(line).alias("value")).write.text(path)


# -- variants


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chr, pos (0-based), ref, alt (the first), qual, info; a quality of . or inf is 0, letters that are no bases an error."""
    return vcf_lines(spark.read.text(path))


def vcf_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    c = F.split(value, "\t")
    alt = F.substring_index(c[4], ",", 1)
    ok = c[3].rlike("^[ACGTNRYSWKMBDHVacgtnryswkmbdhv]+$") & alt.rlike("^([ACGTNRYSWKMBDHVacgtnryswkmbdhv]+|[.])$")
    qual = F.when(F.lower(c[5]).isin(".", "inf"), 0.0).otherwise(c[5].cast("double"))
    return lines.filter(F.trim(value) != "").filter(~F.startswith(F.col(value), F.lit("#"))).select(c[0].alias("chr"), (c[1].cast("long") - 1).alias("pos"), dna.require(ok, c[3], "no bases in REF or ALT").alias("ref"), alt.alias("alt"), qual.alias("qual"), c[7].alias("info"))


def vcf_line() -> Column:
    return F.concat_ws("\t", F.col("chr").cast("string"), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("."), "info")


# -- coverage


def pileup(spark: SparkSession, path: str) -> DataFrame:
    """chr, pos, bp, depth, dots and the parsed reads of a five-column pileup file."""
    df = spark.read.csv(path, sep="\t", schema="chr string, pos int, bp string, depth int, dots string", quote="", mode="FAILFAST")
    return df.withColumn("reads", parsed_pile("dots"))


def depth_runs(piles: DataFrame, order: str = "pos") -> DataFrame:
    """chr, start, stop, n: runs of consecutive positions."""
    run = F.col(order) - F.row_number().over(Window.partitionBy("chr").orderBy(order))
    return piles.withColumn("__run", run).groupBy("chr", "__run").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("n")).drop("__run")


def _goof(content: bytes):
    magic, version = content[:4], content[4:8]
    if magic != b"GOOF" or version not in (b"0100", b"0110"):
        raise ValueError("no GOOF file of version 0100 or 0110")
    bases, n_variants, n_chroms = struct.unpack_from("<3i", content, 8)
    at, bits = 20, 8
    if version == b"0110":
        bits, at = content[20], 21
    chroms = np.frombuffer(content, "<i4", 3 * n_chroms, at).reshape(-1, 3)
    at += 12 * n_chroms
    depth = np.frombuffer(content, {8: "u1", 16: "<u2"}[bits], bases, at)
    at += bases * bits // 8
    layout = np.dtype([("word", "<u4"), ("extra", "<u2"), ("off", "<i4")] if bits == 16 else [("word", "<u4"), ("off", "<i4")])
    return chroms, depth, np.frombuffer(content, layout, n_variants, at)


def goof(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """chroms (chr, off, len), depth (chr, pos, depth) and variants (chr, off, from, to, fwd, rev; four reads at least) of binary coverage files."""
    from ..functions.vcf import decode_snp

    content = spark.read.format("binaryFile").load(path).select("content")

    def table(schema: str, names: list[str], rows):
        def run(batches):
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    columns = rows(*_goof(data))
                    for i in range(0, len(columns[0]), 1 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 20)]) for c in columns], names=names)

        return content.mapInArrow(run, schema)

    def positions(chroms, depth, _):
        ids = np.concatenate([np.full(n, i, np.int32) for i, _, n in chroms] or [np.zeros(0, np.int32)])
        pos = np.concatenate([np.arange(n, dtype=np.int32) for _, _, n in chroms] or [np.zeros(0, np.int32)])
        d = np.concatenate([depth[o : o + n] for _, o, n in chroms] or [depth[:0]]).astype(np.int32)
        return ids, pos, d

    packed = table("word long, extra long, off int", ["word", "extra", "off"], lambda c, d, v: (v["word"].astype(np.int64), (v["extra"] if "extra" in v.dtype.names else np.zeros(len(v))).astype(np.int64), v["off"].astype(np.int32)))
    snp = decode_snp("word", F.col("extra"))
    variants = packed.select(snp.alias("s"), "off").select("s.chr", "off", "s.from", "s.to", "s.fwd", "s.rev").filter("fwd + rev >= 4")
    return {
        "chroms": table("chr int, off int, len int", ["chr", "off", "len"], lambda c, d, v: tuple(np.ascontiguousarray(c[:, i]) for i in range(3))),
        "depth": table("chr int, pos int, depth int", ["chr", "pos", "depth"], positions),
        "variants": variants,
    }


# -- alignments and plain tables


def clustal(df: DataFrame, text: str = "text", key: str = "key") -> DataFrame:
    """key, number, name, alignment of CLUSTAL texts; the conservation line has a null name."""
    lines = df.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("i", "line"), F.startswith(F.col(text), F.lit("CLUSTAL")).alias("ok"))
    lines = lines.filter(dna.require(F.col("ok"), F.lit(True), "no CLUSTAL header")).filter("i > 0 AND trim(line) <> '' OR line LIKE ' %'")
    by = Window.partitionBy(key).orderBy("i")
    cons = F.startswith(F.col("line"), F.lit(" "))
    lines = lines.withColumn("cons", cons).withColumn("block", F.sum(F.col("cons").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("block", F.coalesce("block", F.lit(0)))
    inside = Window.partitionBy(key, "block")
    margin = F.max(F.when(~F.col("cons"), F.length(F.regexp_extract("line", r"^(\S+\s+)", 1)))).over(inside)
    lines = lines.withColumn("number", F.when(F.col("cons"), -1).otherwise(F.row_number().over(inside.orderBy("i")) - 1)).withColumn("part", F.substring(F.col("line"), margin + 1, F.length("line")))
    rows = lines.groupBy(key, "number").agg(F.min(F.when(~F.col("cons"), F.regexp_extract("line", r"^(\S+)", 1))).alias("name"), F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    return rows.select(key, "number", "name", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("alignment"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab file with a header; every cell is text."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def config(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """key, value of `key = value` lines; # starts a comment; the last of repeated keys counts."""
    order = order or "__order"
    df = lines if order in lines.columns else lines.withColumn(order, F.monotonically_increasing_id())
    df = df.filter(~F.startswith(F.trim(value), F.lit("#"))).filter(F.contains(F.col(value), F.lit("=")))
    parts = F.split(value, "=", 2)
    return df.groupBy(F.trim(parts[0]).alias("key")).agg(F.max_by(F.trim(parts[1]), order).alias("value"))


def records_of_four(spark: SparkSession, path: str) -> DataFrame:
    """l1 to l4 of consecutive lines, for files whose records begin with @ after a line break, as in FASTQ."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    number = F.row_number().over(Window.partitionBy("f").orderBy("i")) - 1
    each = lines.withColumn("n", number).groupBy("f", F.floor(F.col("n") / 4).alias("r"))
    return each.agg(*(F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(f"l{k + 1}") for k in range(4))).drop("f", "r")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, md5 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))


def matrix(df: DataFrame, text: str = "text") -> DataFrame:
    """a, b, score of a square substitution matrix in text form: # comments, a header of letters, a row for each letter."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    cells = lambda x: F.split(F.trim(x), r"\s+")
    rows = df.select(cells(lines[0]).alias("head"), F.explode(F.slice(lines, F.lit(2), F.size(lines) - 1)).alias("line")).select("head", cells(F.col("line")).alias("c"))
    return rows.select(F.col("c")[0].alias("a"), F.posexplode("head").alias("i", "b"), "c").select("a", "b", F.get("c", F.col("i") + 1).cast("int").alias("score"))


def lookup_score(pairs: DataFrame, scores: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with score; ? stands for the matrix's *. The matrix is a few hundred rows, so it becomes a map."""
    table = scores.agg(F.map_from_entries(F.collect_list(F.struct(F.concat("a", "b"), "score"))).alias("__m"))
    star = lambda c: F.when(F.col(c) == "?", "*").otherwise(F.col(c))
    return pairs.crossJoin(F.broadcast(table)).withColumn("score", F.try_element_at("__m", F.concat(star(a), star(b)))).drop("__m")
