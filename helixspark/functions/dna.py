"""Sequence expressions: Columns in, Columns out, all inside the JVM. Positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))


def require(ok: Column, value: Column, message: str) -> Column:
    """value where ok holds; an error elsewhere."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def substr(s: Column | str, start: Column | int, length: Column | int) -> Column:
    """length characters from the 0-based start."""
    return F.substring(_c(s), F.lit(start) + 1, F.lit(length))


def positions(last: Column) -> Column:
    """0 to last, none if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


# -- complement, translation


def complement(s: Column | str, strict: bool = False) -> Column:
    s = _c(s)
    return F.translate(F.upper(s), "ACGTN", "TGCAN") if strict else F.translate(s, *tables.COMPLEMENT)


def revcomp(s: Column | str) -> Column:
    return F.reverse(complement(s))


def revcomp_if(flag: Column | str, s: Column | str) -> Column:
    return F.when(_c(flag), revcomp(s)).otherwise(_c(s))


def revcomp_plain(s: Column | str) -> Column:
    """Of A, C, G, T, N only, case kept; line ends turn to spaces."""
    return F.reverse(F.translate(_c(s), "TtCcAaGgNn \n\r-", "AaGgTtCcNn  \r-"))


def _let(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), F.lit(1))


def _amino_acid(codon: Column, code: str) -> Column:
    """Amino acid of a codon in upper case."""
    letters = [F.substring(codon, i, 1) for i in (1, 2, 3)]
    at = [F.call_function("instr", F.lit(tables.BASES), x) for x in letters]
    whole = (F.length(codon) == 3) & (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
    known = F.length(codon) == 3
    for x in letters:
        known = known & (F.call_function("instr", F.lit(tables.BASES + "N"), x) > 0)
    return F.when(whole, F.substring(F.lit(code), at[0] * 16 + at[1] * 4 + at[2] - 20, F.lit(1))).when(known, F.lit("?"))


def codon_to_aa(codon: Column | str, code: str = tables.AMINO_ACIDS) -> Column:
    """Amino acid of a codon; ? with an N in it, null with any other letter."""
    return _let(F.upper(_c(codon)), lambda c: _amino_acid(c, code))


def translate(s: Column | str, code: str = tables.AMINO_ACIDS) -> Column:
    """Protein of frame 0; one or two bases at the end are ignored."""
    n = lambda t: F.floor(F.length(t) / 3).cast("int")
    each = lambda t: F.transform(positions(n(t) - 1), lambda i: _let(substr(t, i * 3, 3), lambda c: _amino_acid(c, code)))
    return _let(F.upper(_c(s)), lambda t: F.array_join(each(t), ""))


def trigram(aa: Column | str) -> Column:
    return F.element_at(literal_map(tables.TRIGRAMS), _c(aa))


# -- validation, slices


def validated(s: Column | str, mode: str = "explicit") -> Column:
    """Upper-cased sequence; an error for letters outside the mode's alphabet (explicit: ACGT, ambiguous: IUPAC)."""
    letters = {"explicit": "ACGT", "ambiguous": tables.IUPAC}[mode]
    u = F.upper(_c(s))
    return require(u.rlike(f"^[{letters}]*$"), u, f"sequence outside the {mode} alphabet")


def is_dna(s: Column | str, strict: bool = False) -> Column:
    return F.upper(_c(s)).rlike(f"^[{'ACGT' if strict else tables.IUPAC}]*$")


def item(s: Column | str, i: Column | int) -> Column:
    return substr(s, i, 1)


def piece(s: Column | str, first: Column | int, last: Column | int) -> Column:
    """Inclusive slice."""
    return substr(s, first, F.lit(last) - F.lit(first) + 1)


def split_after(s: Column | str, i: int) -> Column:
    s = _c(s)
    return F.struct(F.substring(s, 1, i + 1).alias("head"), F.substring(s, F.lit(i + 2), F.length(s)).alias("tail"))


def _before(q: Column) -> Column:
    """Pattern that matches, without width, before each occurrence of q."""
    return F.concat(F.lit("(?=\\Q"), F.replace(q, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))


def indices_of(s: Column | str, q: Column | str) -> Column:
    """All starts of q (not empty) in s, overlapping ones too, ascending. Linear in the length of s."""
    s, q = _c(s), _c(q)
    parts = F.split(s, _before(q))
    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, x: F.struct((acc["next"] + F.length(x)).alias("next"), F.array_append(acc["starts"], acc["next"]).alias("starts"))
    starts = F.aggregate(parts, zero, step, lambda acc: acc["starts"])
    return F.when(F.startswith(s, q), starts).otherwise(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))))


def count_of(s: Column | str, q: Column | str) -> Column:
    s, q = _c(s), _c(q)
    return F.size(F.split(s, _before(q))) - F.when(F.startswith(s, q), 0).otherwise(1)


def longest_prefix(text: Column | str, q: Column | str) -> Column:
    """Length of the longest prefix of q that text has anywhere."""
    text, q = _c(text), _c(q)
    return F.size(F.filter(positions(F.length(q) - 1), lambda i: F.call_function("instr", text, F.substring(q, F.lit(1), i + 1)) > 0))


def wrap(s: Column | str, width: int = 60, end: bool = False) -> Column:
    """Lines of so many characters; end: a line end at the end too."""
    lines = F.regexp_replace(_c(s), f"(?s)(.{{{width}}})(?=.)", "$1\n")
    return F.concat(lines, F.lit("\n")) if end else lines


def strip_newlines(s: Column | str) -> Column:
    return F.translate(_c(s), "\n\r ", "")


def upper_bases(s: Column | str) -> Column:
    return F.translate(_c(s), "acgt", "ACGT")


def lower_bases(s: Column | str) -> Column:
    return F.translate(_c(s), "ACGT", "acgt")


def dna_order(s: Column | str) -> list[Column]:
    """Sort keys: shorter first, then by letters."""
    return [F.length(_c(s)), _c(s)]


# -- composition


def gc(s: Column | str) -> Column:
    s = _c(s)
    return F.regexp_count(s, F.lit("[GCgc]")) / F.nullif(F.length(s), F.lit(0))


def gc_first(s: Column | str, n: Column | int) -> Column:
    return gc(F.substring(_c(s), F.lit(1), F.lit(n)))


def self_complementary(s: Column | str) -> Column:
    s = _c(s)
    return (F.length(s) % 2 == 0) & s.rlike("^[ACGT]*$") & (s == F.reverse(F.translate(s, "ACGT", "TGCA")))


def has_polyrun(s: Column | str, n: int) -> Column:
    """A base, or a pair of bases, n times in a row."""
    s = _c(s)
    return (F.length(s) >= n) if n <= 1 else s.rlike(f"(.)\\1{{{n - 1}}}") | s.rlike(f"(..)\\1{{{n - 1}}}")


def has_g_run(s: Column | str, n: int) -> Column:
    return _c(s).rlike(f"G{{{n}}}")


# -- k-mers


def kmers(s: Column | str, k: int) -> Column:
    """Array of (pos, kmer)."""
    s = _c(s)
    return F.transform(positions(F.length(s) - k), lambda i: F.struct(i.alias("pos"), substr(s, i, k).alias("kmer")))


def kmer_digits(s: Column | str) -> Column:
    """Base-4 digits, G=0 A=1 T=2 C=3; their order is that of the numbers at equal length."""
    return F.translate(_c(s), "GATC", "0123")


def kmer_number(s: Column | str) -> Column:
    """The number of up to 32 bases, unsigned 64-bit, as decimal(20,0)."""
    return F.conv(kmer_digits(s), 4, 10).cast("decimal(20,0)")


def canonical_kmer(s: Column | str) -> Column:
    """The smaller of the digits of a k-mer and of its reverse complement."""
    s = _c(s)
    return F.least(kmer_digits(s), F.reverse(F.translate(s, "CTAG", "0123")))


# -- two sequences


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    unlike = F.filter(positions(n - 1), lambda i: substr(a, i, 1) != substr(b, i, 1))
    return F.coalesce(F.try_element_at(unlike, F.lit(1)), n)


def mismatched_tails(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    p = common_prefix(a, b)
    return F.struct(substr(a, p, F.length(a)).alias("tail_a"), substr(b, p, F.length(b)).alias("tail_b"))


def equal_with_indel(a: Column | str, b: Column | str) -> Column:
    """Equal, EqualWithIndel (one base more inside one of both) or NotEqual."""
    a, b = _c(a), _c(b)
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    p = common_prefix(long, short)
    inside = (F.length(long) - F.length(short) == 1) & (p > 0) & (p < F.length(short)) & (substr(long, p + 1, F.length(long)) == substr(short, p, F.length(short)))
    return F.when(a == b, "Equal").when(inside, "EqualWithIndel").otherwise("NotEqual")


# -- alignments


def count_mismatches(a: Column | str, b: Column | str) -> Column:
    """Mismatches between the first and the last column of b that is no gap."""
    a, b = _c(a), _c(b)
    first = F.length(F.regexp_extract(b, "^-*", 0))
    last = F.length(b) - F.length(F.regexp_extract(b, "-*$", 0)) - 1
    count = F.size(F.filter(positions(F.length(b) - 1), lambda i: (i >= first) & (i <= last) & (substr(a, i, 1) != substr(b, i, 1))))
    return require(F.length(a) == F.length(b), count, "alignment rows differ in length")


def mismatch_positions(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return F.filter(positions(F.least(F.length(a), F.length(b)) - 1), lambda i: substr(a, i, 1) != substr(b, i, 1))


def aln_to_seq(aln: Column | str, offset: Column | int = 0) -> Column:
    """Sequence position of each alignment column, null at gaps."""
    aln = _c(aln)
    until = lambda i: F.length(F.replace(F.substring(aln, F.lit(1), i + 1), F.lit("-"), F.lit("")))
    return F.transform(positions(F.length(aln) - 1), lambda i: F.when(substr(aln, i, 1) != "-", F.lit(offset) - 1 + until(i)))


def seq_to_aln(aln: Column | str, offset: Column | int, length: Column | int) -> Column:
    """Alignment column of each of length sequence positions; null for those outside the alignment, which starts at offset."""
    aln = _c(aln)
    columns = F.filter(positions(F.length(aln) - 1), lambda i: substr(aln, i, 1) != "-")
    return F.transform(positions(F.lit(length) - 1), lambda i: F.when(i >= F.lit(offset), F.get(columns, i - F.lit(offset))))


def alignment_bounds(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    lead = lambda x: F.length(F.regexp_extract(x, "^-*", 0))
    last = lambda x: F.length(x) - F.length(F.regexp_extract(x, "-*$", 0)) - 1
    return F.struct(F.greatest(lead(a), lead(b)).alias("first"), F.least(last(a), last(b)).alias("last"))


def locate_alignment(aln: Column | str, s: Column | str) -> Column:
    """(l, r) of an ungapped alignment row in a sequence; an error if it isn't there."""
    bare = F.replace(_c(aln), F.lit("-"), F.lit(""))
    at = F.call_function("instr", _c(s), bare)
    return F.struct(require(at > 0, at - 1, "alignment not found").alias("l"), (at - 2 + F.length(bare)).alias("r"))


# -- paths and lines


def base_name(p: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(_c(p), "/+$", ""), "/"), -1)


def base_dir(p: Column | str) -> Column:
    return F.regexp_replace(_c(p), "/[^/]*$", "")


def join_path(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("/", _c(a), _c(b))


def forward_slashes(p: Column | str) -> Column:
    return F.replace(_c(p), F.lit("\\"), F.lit("/"))


def replace_suffix(p: Column | str, suffix: str) -> Column:
    return F.concat(F.regexp_replace(_c(p), "\\.[^.]*$", ""), F.lit(suffix))


def chromosome_number(name: Column | str) -> Column:
    """Of an accession or a number's text."""
    name = _c(name)
    return F.coalesce(F.try_element_at(literal_map(tables.chromosomes()), name), name.try_cast("int"))
