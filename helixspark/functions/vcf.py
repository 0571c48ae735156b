"""Fields of variants as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import _c, literal_map, require
from .tables import VCF_STATUS

_FLOAT = r"([0-9.]+(?:[eE][-+]?[0-9]+)?)"


def _found(info: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(info, pattern, group), F.lit(""))


def depth(info: Column | str) -> Column:
    """DP as text."""
    return _found(_c(info), "DP=([0-9]+)", 1)


def dp4(info: Column | str) -> Column:
    p = r"DP4=(\d+),(\d+),(\d+),(\d+)"
    return F.when(_c(info).rlike(p), F.struct(*(F.regexp_extract(_c(info), p, i + 1).cast("int").alias(n) for i, n in enumerate(("reffwd", "refrev", "altfwd", "altrev")))))


def pv4(info: Column | str) -> Column:
    p = "PV4=" + ",".join([_FLOAT] * 4)
    return F.when(_c(info).rlike(p), F.struct(*(F.regexp_extract(_c(info), p, i + 1).try_cast("double").alias(n) for i, n in enumerate(("strand", "base_q", "map_q", "tail")))))


def map_quality(info: Column | str) -> Column:
    return _found(_c(info), r"MQ=(\d+)", 1).try_cast("int")


def kind(ref: Column | str, alt: Column | str) -> Column:
    n = F.length(_c(ref))
    return F.when(n != F.length(_c(alt)), "INDEL").when(n == 1, "SNP").otherwise("MNP")


def call_depth(d: Column) -> Column:
    return d["reffwd"] + d["refrev"] + d["altfwd"] + d["altrev"]


def mutness(d: Column) -> Column:
    """Share of reads with the variant; NaN without reads."""
    n = call_depth(d)
    return F.when(n == 0, F.lit(float("nan"))).otherwise((d["altfwd"] + d["altrev"]) / F.nullif(n, F.lit(0)))


def split_mnp(pos: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """Array of (pos, ref, alt): one for each base."""
    ref, alt = _c(ref), _c(alt)
    each = F.transform(F.sequence(F.lit(0), F.length(ref) - 1), lambda i: F.struct((_c(pos) + i).alias("pos"), F.substring(ref, i + 1, F.lit(1)).alias("ref"), F.substring(alt, i + 1, F.lit(1)).alias("alt")))
    return require((F.length(ref) == F.length(alt)) & (F.length(ref) > 1), each, "not a multi-nucleotide variant")


def applied(seq: Column | str, offset: Column | int, pos: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """seq, which starts at offset, with alt in the place of ref; an error out of range or where ref isn't there."""
    seq, ref, x = _c(seq), _c(ref), _c(pos) - F.lit(offset)
    there = (x >= 0) & (x + F.length(ref) <= F.length(seq)) & (F.substring(seq, x.cast("int") + 1, F.length(ref)) == ref)
    out = F.concat(F.substring(seq, F.lit(1), x.cast("int")), _c(alt), F.substring(seq, x.cast("int") + 1 + F.length(ref), F.length(seq)))
    return require(there, out, "variant doesn't fit its sequence")


def label(status: Column | str) -> Column:
    return F.element_at(literal_map(VCF_STATUS), _c(status))


def hard_filter(d: Column, mq: Column, pv: Column, least: int = 2, most: int = 10_000_000, alt: int = 2, quality: int = 10, p: tuple[float, ...] = (1e-4, 1e-100, 0.0, 1e-4)) -> Column:
    """Status before neighbours are looked at, the first rule that fails counts."""
    bad = (pv["strand"] < p[0]) | (pv["base_q"] < p[1]) | (pv["map_q"] < p[2]) | (pv["tail"] < p[3])
    return F.when(call_depth(d) < least, "DEPTH_TOO_LOW").when(call_depth(d) > most, "DEPTH_TOO_HIGH").when(d["altfwd"] + d["altrev"] < alt, "ALT_DEPTH_TOO_LOW").when(mq < quality, "MAPPING_QUAL_TOO_LOW").when(F.coalesce(bad, F.lit(False)), "FAILED_PV").otherwise("PASS")


def decode_snp(word: Column | str, extra: Column | int = 0) -> Column:
    """Bit-packed variant: chr, from, to, fwd, rev; extra: the high bytes of both counts, of the wider layout."""
    w, x = _c(word).cast("long"), F.lit(extra).cast("long")
    base = lambda b: F.substring(F.lit("ACGT"), b.bitwiseAND(3).cast("int") + 1, F.lit(1))
    byte = lambda v, n: F.shiftright(v, n).bitwiseAND(255)
    return F.struct(w.bitwiseAND(255).alias("chr"), base(F.shiftright(w, 8)).alias("from"), base(F.shiftright(w, 12)).alias("to"), (byte(w, 16) + byte(x, 0) * 256).alias("fwd"), (byte(w, 24) + byte(x, 8) * 256).alias("rev"))
