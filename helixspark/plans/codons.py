"""Codon tables as DataFrames: the dimension of 64 codons, usage, ranks, choices, text layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna, tables


def codons(spark: SparkSession, code: str = tables.AMINO_ACIDS) -> DataFrame:
    """codon, aa: 64 rows."""
    b = F.array(*map(F.lit, tables.BASES))
    three = F.flatten(F.transform(b, lambda x: F.flatten(F.transform(b, lambda y: F.transform(b, lambda z: F.concat(x, y, z))))))
    return spark.range(1).select(F.explode(three).alias("codon")).withColumn("aa", dna.codon_to_aa("codon", code))


def usage(genes: DataFrame, seq: str = "seq", keep: Column | None = None) -> DataFrame:
    """codon, n: in-frame codons of all genes up to their first stop, which counts; all 64 codons are there."""
    s = genes.filter(keep) if keep is not None else genes
    triples = F.transform(dna.positions(F.floor(F.length(seq) / 3).cast("int") - 1), lambda i: dna.substr(seq, i * 3, 3))
    stops = F.array_position(F.transform(triples, lambda c: dna.codon_to_aa(c)), "*")
    upto = F.when(stops > 0, F.slice(triples, 1, stops.cast("int"))).otherwise(triples)
    counts = s.select(F.explode(upto).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
    return codons(genes.sparkSession).join(counts, "codon", "left").select("codon", "aa", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ranked(table: DataFrame, least: float = 0.0, most: int = 64) -> DataFrame:
    """table: codon, aa, freq. Adds rank (by frequency, then codon), rel1 and, over those at least `least` and ranked `most` at most, rel2."""
    by = Window.partitionBy("aa")
    floor = F.greatest("freq", F.lit(1e-6))
    t = table.withColumn("rank", F.row_number().over(by.orderBy(F.desc("freq"), "codon"))).withColumn("rel1", floor / F.sum(floor).over(by))
    t = t.filter((F.col("rel1") >= least) & (F.col("rank") <= most))
    return t.withColumn("rel2", F.col("rel1") / F.sum("rel1").over(by))


def optimised(proteins: DataFrame, protein: str, table: DataFrame) -> DataFrame:
    """proteins with dna: the most frequent codon of each residue. The codon map has a row an amino acid, so it is broadcast."""
    best = ranked(table, most=1).agg(F.map_from_entries(F.collect_list(F.struct("aa", "codon"))).alias("__best"))
    text = F.array_join(F.transform(F.filter(F.split(protein, ""), lambda a: a != ""), lambda a: F.try_element_at("__best", a)), "")
    return proteins.crossJoin(F.broadcast(best)).withColumn("dna", text).drop("__best")


def chosen(draws: DataFrame, table: DataFrame) -> DataFrame:
    """draws: id, aa, r. Adds codon: the first whose cumulated rel2, the least used first, exceeds r."""
    order = Window.partitionBy("aa").orderBy(F.desc("rank"))
    cum = table.withColumn("cum", F.sum("rel2").over(order)).groupBy("aa").agg(F.array_sort(F.collect_list(F.struct("cum", "codon"))).alias("choices"))
    return draws.join(F.broadcast(cum), "aa").select("id", "aa", "r", F.get(F.filter("choices", lambda c: c["cum"] > F.col("r")), F.lit(0))["codon"].alias("codon"))


def kazusa(table: DataFrame) -> DataFrame:
    """table: codon, n. block, line, text: sixteen lines of four codons with rates in a thousand and counts."""
    total = table.agg(F.sum("n").alias("total"))
    cell = F.format_string("%s%5.1f(%6d)", F.translate("codon", "T", "U"), F.col("n") * 1000.0 / F.col("total"), "n")
    at = lambda i: F.call_function("instr", F.lit(tables.BASES), F.substring("codon", i, 1))
    rows = table.crossJoin(F.broadcast(total)).select(at(1).alias("block"), at(3).alias("line"), F.struct(at(2).alias("k"), cell.alias("cell")).alias("x"))
    return rows.groupBy("block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cell"]), "  ").alias("text"))


def gcg(table: DataFrame) -> DataFrame:
    """table: codon, aa, n. aa, codon, text: trigram, count, rate in a thousand, share of the amino acid."""
    by = Window.partitionBy("aa")
    total = table.agg(F.sum("n").alias("total"))
    share = F.coalesce(F.col("n") / F.nullif(F.sum("n").over(by), F.lit(0)), F.lit(0.0))
    text = F.format_string("%s %s %10.2f %10.2f %10.2f", dna.trigram("aa"), "codon", F.col("n").cast("double"), F.col("n") * 1000.0 / F.col("total"), share)
    return table.crossJoin(F.broadcast(total)).select("aa", "codon", text.alias("text"))


def parse_codon_table(lines: DataFrame, text: str = "value") -> DataFrame:
    """codon, freq from lines of cells like `UUU 17.6( 1234)`; an error for lines without cells."""
    cells = F.regexp_extract_all(text, F.lit(r"([AUCGT]{3})\s*(\d*\.?\d*)\s*\(\s*\d*\)"), F.lit(0))
    found = lines.filter(F.trim(text) != "").select(F.explode(F.when(F.size(cells) > 0, cells).otherwise(F.array(F.raise_error(F.lit("bad codon table line"))))).alias("cell"))
    return found.select(F.translate(F.substring("cell", 1, 3), "U", "T").alias("codon"), F.regexp_extract("cell", r"[A-Z]{3}\s*(\d*\.?\d*)", 1).try_cast("double").alias("freq"))
