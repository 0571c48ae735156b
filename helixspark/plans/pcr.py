"""Primer hits, PCR products and stitching of constructs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from .kmers import dealt


def seeds(genome: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """key, pos, kmer: all k-mers of the plus strand."""
    return dealt(genome.select(key, seq), key).select(key, F.explode(dna.kmers(seq, k)).alias("__k")).select(key, F.col("__k.pos").alias("pos"), F.col("__k.kmer").alias("kmer"))


#: Lengths of seeds, the longest that fits is taken.
SEEDS = (16, 12, 6, 3, 1)


def primer_hits(genome: DataFrame, primers: DataFrame, key: str = "chr", seq: str = "seq", primer_id: str = "primer_id", primer: str = "primer", k: int = SEEDS[0]) -> DataFrame:
    """primer_id, key, pos (leftmost base on the plus strand), fwd of every exact hit on both strands.

    A primer is cut into seeds, the last of which ends with it. Seeds meet the genome's k-mers in an equi-join, and a primer hits where
    all its seeds do; no primer is held against every chromosome, and no chromosome goes along with a hit. Neither side may be
    broadcast, as Spark takes them for as small as what they are cut from. Primers shorter
    than k have shorter seeds; empty ones hit nothing.
    """
    both = primers.select(primer_id, F.explode(F.array(F.struct(F.lit(True).alias("fwd"), F.col(primer).alias("s")), F.struct(F.lit(False).alias("fwd"), dna.revcomp(primer).alias("s")))).alias("x"))
    both = both.select(primer_id, "x.fwd", "x.s").filter(F.length("s") > 0)
    size = F.lit(1)
    for n in sorted({k, *(n for n in SEEDS if n < k)}):
        size = F.when(F.length("s") >= n, n).otherwise(size)
    both = both.withColumn("__k", size)
    found = None
    for n in sorted(r[0] for r in both.select("__k").distinct().collect()):  # as many as there are lengths of seeds
        own = both.filter(F.col("__k") == n)
        starts = F.array_union(F.sequence(F.lit(0), F.length("s") - n, F.lit(n)), F.array(F.length("s") - n))
        cut = own.select(primer_id, "fwd", F.size(starts).alias("__seeds"), F.explode(starts).alias("__at"), "s").withColumn("kmer", F.substring("s", F.col("__at") + 1, F.lit(n))).drop("s")
        hits = seeds(genome, key, seq, n).join(cut.hint("merge"), "kmer").groupBy(primer_id, key, "fwd", (F.col("pos") - F.col("__at")).alias("pos"), "__seeds").agg(F.count(F.lit(1)).alias("__n"))
        hits = hits.filter("__n = __seeds").select(primer_id, key, "pos", "fwd")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else genome.select(key).join(primers.select(primer_id), F.lit(False)).select(primer_id, key, F.lit(0).alias("pos"), F.lit(True).alias("fwd"))


def products(genome: DataFrame, pairs: DataFrame, longest: int = 10_000, key: str = "chr", seq: str = "seq", k: int = SEEDS[0]) -> DataFrame:
    """pairs: pair_id, fwd_primer, rev_primer. pair_id, key, l, r, fwd, n of all products of at most so many bases.

    The nearest reverse site behind each forward hit counts, found in one pass over a pair's hits in the order of their places.
    Mirrored products of equal primers count once.
    """
    # Primers of both kinds meet the genome's seeds at once.
    kinds = F.array(*(F.struct(F.struct("pair_id", F.length(c).alias("n"), F.lit(kind).alias("kind")).alias("__id"), F.col(c).alias("primer")) for kind, c in ((1, "fwd_primer"), (0, "rev_primer"))))
    asked = pairs.filter("pair_id IS NOT NULL").select(F.explode(kinds).alias("x")).select("x.__id", "x.primer")
    hits = primer_hits(genome, asked, key, seq, "__id", "primer", k)
    fwd = F.col("fwd") == (F.col("__id.kind") == 1)
    hits = hits.select("__id.pair_id", key, "pos", fwd.alias("fwd"), "__id.n", "__id.kind")
    end = F.col("pos") + F.col("n")
    x = F.when(F.col("fwd"), -F.when(F.col("kind") == 1, end).otherwise(F.col("pos"))).otherwise(F.when(F.col("kind") == 1, F.col("pos")).otherwise(end))
    seen = Window.partitionBy("pair_id", key, "fwd").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    site = F.last(F.when(F.col("kind") == 0, F.struct("pos", "n")), ignorenulls=True).over(seen)
    met = hits.withColumn("x", x).withColumn("b", site).filter("kind = 1 AND b IS NOT NULL")
    left, right = F.when(F.col("fwd"), F.col("pos")).otherwise(F.col("b.pos")), F.when(F.col("fwd"), F.col("b.pos") + F.col("b.n") - 1).otherwise(F.col("pos") + F.col("n") - 1)
    found = met.select("pair_id", key, "fwd", left.alias("l"), right.alias("r")).withColumn("n", F.col("r") - F.col("l") + 1).filter(F.col("n") <= longest)
    return found.groupBy("pair_id", key, "l", "r", "n").agg(F.bool_or("fwd").alias("fwd"))


def product_bases(found: DataFrame, genome: DataFrame, key: str = "chr", seq: str = "seq") -> DataFrame:
    """found with product: the bases of each product, as the forward primer reads them."""
    bases = dna.substr(seq, F.col("l"), F.col("n"))
    return found.join(genome.select(key, seq).hint("merge"), key).withColumn("product", F.when(F.col("fwd"), bases).otherwise(dna.revcomp(bases))).drop(seq)


def unique_product(found: DataFrame, key: str = "chr", slack: int = 10) -> DataFrame:
    """The product of each pair that has one, or two on one chromosome of about one length; none for pairs with more."""
    w = Window.partitionBy("pair_id")
    rank = F.row_number().over(w.orderBy(key, "l", "r"))
    n = F.count(F.lit(1)).over(w)
    alike = (F.min(key).over(w) == F.max(key).over(w)) & (F.max("n").over(w) - F.min("n").over(w) <= slack)
    return found.withColumn("__rank", rank).withColumn("__ok", (n == 1) | (n == 2) & alike).filter("__rank = 1 AND __ok").drop("__rank", "__ok")


def stitched(a: Column | str, b: Column | str, least: int, most: int | None = None) -> Column:
    """a and b merged over the shortest overlap of a's end with b's start of at least so many bases; null without one."""
    a, b = dna._c(a), dna._c(b)
    top = F.least(F.length(a), F.length(b), *([F.lit(most)] if most else []))
    sizes = F.when(top >= least, F.sequence(F.lit(least), F.greatest(top, F.lit(least)))).otherwise(F.array().cast("array<int>"))
    n = F.try_element_at(F.filter(sizes, lambda k: F.right(a, k) == F.left(b, k)), F.lit(1))
    return F.when(n.isNotNull(), F.concat(a, F.substring(b, n + 1, F.length(b))))


def stitch_request(a: str, margin_a: str, b: str, margin_b: str, least: int, most: int) -> Column:
    """struct(ok, value, messages): b is given on the other strand; margins must end and begin their sequences."""
    rb, rm = dna.revcomp(b), dna.revcomp(margin_b)
    messages = F.array_compact(
        F.array(
            F.when(~F.startswith(F.col(a), F.col(margin_a)), F.lit("first margin doesn't begin its sequence")),
            F.when(~F.endswith(rb, rm), F.lit("second margin doesn't end its sequence")),
            F.when(F.length(F.col(a)) < least, F.lit("first sequence shorter than the overlap")),
            F.when(F.length(F.col(b)) < least, F.lit("second sequence shorter than the overlap")),
        )
    )
    ok = F.size(messages) == 0
    return F.struct(ok.alias("ok"), F.when(ok, stitched(a, rb, least, most)).alias("value"), messages.alias("messages"))
