"""Small cases whose results are known, and order-dependent operators against plain Python."""

import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixspark.functions import dna, result, stats, thermo
from helixspark.operators import alignment
from helixspark.operators.variant_filter import Limits, judge
from helixspark.plans import codons, pcr
from helixspark.sources import formats


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


def test_translate(spark):
    assert one(spark, dna.translate("s"), s="ATGCG") == "M"
    assert one(spark, dna.translate("s"), s="AT") == ""
    assert one(spark, dna.translate("s"), s="atgTAAnnn") == "M*?"
    assert one(spark, dna.translate("s"), s="ATG" * 2000) == "M" * 2000


def test_complement_table(spark):
    assert one(spark, dna.revcomp("s"), s="AcgTNrys-\n") == " -SRYNAcgT"


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 120, 121])
def test_wrap(spark, n):
    s = "A" * n
    assert one(spark, dna.wrap("s"), s=s) == "\n".join(s[i : i + 60] for i in range(0, n, 60))


def test_validate_raises(spark):
    with pytest.raises(Exception, match="alphabet"):
        one(spark, dna.validated("s"), s="ACGX")


@pytest.mark.parametrize(("a", "b", "kind"), [("atcg", "atAcg", "EqualWithIndel"), ("atcg", "atcgA", "NotEqual"), ("Catcg", "atcg", "NotEqual"), ("ATC", "AGC", "NotEqual"), ("AAA", "AAA", "Equal"), ("A", "A", "Equal")])
def test_indel(spark, a, b, kind):
    assert one(spark, dna.equal_with_indel("a", "b"), a=a, b=b) == kind
    assert one(spark, dna.equal_with_indel("a", "b"), a=b, b=a) == kind


@pytest.mark.parametrize(("s", "q", "at"), [("BANANAS", "ANA", [1, 3]), ("AAAA", "AA", [0, 1, 2]), ("x", "y", []), ("a.b.", ".", [1, 3])])
def test_indices(spark, s, q, at):
    assert one(spark, dna.indices_of("s", "q"), s=s, q=q) == at
    assert one(spark, dna.count_of("s", "q"), s=s, q=q) == len(at)


def test_stitch(spark):
    a, b = "TTTTTTTTTTACGTACGTCC", "ACGTACGTCCGGGGGGGGGG"
    assert one(spark, pcr.stitched("a", "b", 8), a=a, b=b) == a + b[10:]
    assert one(spark, pcr.stitched("a", "b", 11), a=a, b=b) is None


def test_special_functions(spark):
    row = spark.range(1).select(stats.gamma(F.lit(5.0)).alias("g"), stats.ibeta(F.lit(2.0), F.lit(3.0), F.lit(0.5)).alias("i"), stats.student_cdf(F.lit(-2.0), 10.0).alias("t"), stats.lower_gamma(F.lit(1.0), F.lit(1.0)).alias("lo")).first()
    assert row["g"] == pytest.approx(24)
    assert row["i"] == pytest.approx(0.6875)
    assert row["t"] == pytest.approx(0.0366940, abs=1e-6)
    assert row["lo"] == pytest.approx(0.6321205588)


def test_melting_of_ambiguous(spark):
    assert 0 < one(spark, thermo.melting("s"), s="ACGTNNACGTAC") < 80


def test_pile():
    found, starts, stops, fwd, rev = alignment.parse_pile("^].,+2ACa$*T-1g")
    assert (found, starts, stops, fwd, rev) == ([("INS", 2, "AC"), ("SNP", 1, "a"), ("SNP", 1, "T"), ("DEL", 1, "g")], 1, 1, 2, 2)
    with pytest.raises(ValueError, match="pileup"):
        alignment.parse_pile("!")


def test_align_gap():
    s = "ACGTTGCAAGCTTACCGGATTACAGCTAGCTAGGATCCA"
    ok, a, b, score = alignment.align(s, s[:20] + "A" + s[20:], 8, 12)
    assert ok and b.replace("-", "") == s[:20] + "A" + s[20:] and a.count("-") == 1 and score == 40 * len(s) - 40
    assert not alignment.align("AAAAAAAAAAAA", "CCCCCCCCCCCC")[0]


def test_scars():
    r, m = "ACGTTGCAAGCTTACCGGATTACAGC", "GGGTTTCCCAAAGAGAGTCTCACACA"
    assert alignment.scar(r + m + r, 20, 100) == (True, r, None)
    assert alignment.scar(r + m + r[:10] + "C" + r[10:], 20, 100)[1] is not None
    assert alignment.scar(r + m + m[::-1], 20, 100) == (True, None, None)
    assert not alignment.scar("ACGT", 20, 100)[0]


def test_variant_rules():
    v = lambda pos, ref, alt, qual=30.0, depth=5, status="PASS": (pos, ref, alt, qual, depth, status)
    f = lambda *rows: judge(pd.DataFrame(rows, columns=["pos", "ref", "alt", "qual", "alt_depth", "status"]), Limits())
    assert f(v(10, "A", "C"), v(12, "A", "AT")) == ["NEIGHBORING_INDEL", "PASS"]
    assert f(v(10, "A", "AT"), v(12, "A", "C")) == ["PASS", "NEIGHBORING_INDEL"]
    assert f(v(10, "A", "AT", 50.0), v(15, "A", "AT")) == ["PASS", "BETTER_NEIGHBORING_MUTATION"]
    assert f(v(10, "A", "AT"), v(15, "A", "AT", 50.0)) == ["BETTER_NEIGHBORING_MUTATION", "PASS"]
    assert f(v(10, "A", "AT"), v(40, "A", "AT")) == ["PASS", "PASS"]
    assert f(v(10, "A", "AT", status="FAILED_PV"), v(12, "A", "C")) == ["FAILED_PV", "PASS"]


def test_result(spark):
    x = result.checked(F.lit(3), [(F.lit(False), "a"), (F.lit(True), "b"), (F.lit(None).cast("boolean"), "c")])
    assert one(spark, x).messages == ["a", "c"]
    assert one(spark, result.status(result.succeeded(F.lit(1), "w"))) == "Warn"
    assert one(spark, result.bound(result.succeeded(F.lit(1), "w"), lambda v: result.succeeded(v + 1)))["value"] == 2


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fsa").write_text(">chr1 first\nACGT\nAC\r\n>chr2\n\nGG\n>chr1 again\nT\n")
    found = sorted(map(tuple, formats.fasta(spark, str(tmp_path / "g.fsa")).collect()))
    assert found == [("chr1", "ACGTAC"), ("chr1", "T"), ("chr2", "GG")]
    assert {r[0] for r in formats.fasta(spark, str(tmp_path / "g.fsa"), header="full").collect()} == {"chr1 first", "chr2", "chr1 again"}
    with pytest.raises(Exception, match="twice"):
        formats.fasta(spark, str(tmp_path / "g.fsa"), duplicates="error").collect()
    df = spark.createDataFrame([("b", "A" * 61), ("a", "")], "name string, seq string")
    formats.write_fasta(df, str(tmp_path / "out"))
    assert sorted(map(tuple, formats.fasta(spark, str(tmp_path / "out")).collect())) == [("a", ""), ("b", "A" * 61)]


def test_sgd_and_vcf(spark, tmp_path):
    lines = ["S1\tORF\tVerified\tYAR014C\tBUD14\t\tchromosome 1\t\t1\t168866\t166743\tC\t\t2004\t2004\ttext", "bad\tline"]
    (tmp_path / "f.tab").write_text("\n".join(lines))
    assert tuple(formats.read_sgd(spark, str(tmp_path / "f.tab")).first()) == (1, 166743, 168866, "BUD14/BUD14/text/", "ORF", False, "BUD14", "YAR014C", "S1")
    (tmp_path / "v.vcf").write_text("#h\n\nchr1\t10\t.\tA\tC,G\t.\t.\tDP=3\n")
    assert tuple(formats.vcf(spark, str(tmp_path / "v.vcf")).first()) == ("chr1", 9, "A", "C", 0.0, "DP=3")
    (tmp_path / "w.vcf").write_text("chr1\t10\t.\tZ\tC\t1\t.\tDP=3\n")
    with pytest.raises(Exception, match="no bases"):
        formats.vcf(spark, str(tmp_path / "w.vcf")).collect()


@pytest.mark.parametrize("bits", [8, 16])
def test_goof(spark, tmp_path, bits):
    data = b"GOOF0110" + struct.pack("<3i", 5, 2, 2) + bytes([bits]) + struct.pack("<6i", 1, 0, 3, 2, 3, 2)
    data += struct.pack("<5B" if bits == 8 else "<5H", 1, 2, 3, 4, 5)
    word = lambda c, a, b, f, r: c | a << 8 | b << 12 | f << 16 | r << 24
    extra = b"" if bits == 8 else struct.pack("<H", 1)
    for w, off in ((word(1, 0, 3, 4, 1), 7), (word(2, 1, 2, 1, 1), 9)):
        data += struct.pack("<I", w) + extra + struct.pack("<i", off)
    (tmp_path / "x.goo").write_bytes(data)
    t = formats.goof(spark, str(tmp_path / "x.goo"))
    assert sorted(map(tuple, t["chroms"].collect())) == [(1, 0, 3), (2, 3, 2)]
    assert [r.depth for r in t["depth"].orderBy("chr", "pos").collect()] == [1, 2, 3, 4, 5]
    found = sorted(map(tuple, t["variants"].collect()))
    assert found == ([(1, 7, "A", "T", 4, 1)] if bits == 8 else [(1, 7, "A", "T", 260, 1), (2, 9, "C", "G", 257, 1)])


def test_clustal(spark):
    text = "CLUSTAL W\n\n\nseqA   ACGT\nseqB   A-GT\n       * **\n\nseqA   GG\nseqB   GA\n       * \n"
    found = {r.number: (r.name, r.alignment) for r in formats.clustal(spark.createDataFrame([(1, text)], "key int, text string")).collect()}
    assert found == {0: ("seqA", "ACGTGG"), 1: ("seqB", "A-GTGA"), -1: (None, "* *** ")}


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n01\tx\n2\ty\n")
    assert sorted(map(tuple, formats.tsv(spark, str(tmp_path / "t.tsv")).collect())) == [("01", "x"), ("2", "y")]
    (tmp_path / "c.cfg").write_text("# no\na = 1\nb=\na = 2=3\n")
    assert dict(map(tuple, formats.config(spark.read.text(str(tmp_path / "c.cfg"))).collect())) == {"a": "2=3", "b": ""}
    (tmp_path / "r.fq").write_text("@1\nAC\n+\nII\n@2\nGG\n+\nJJ\n")
    assert sorted(map(tuple, formats.records_of_four(spark, str(tmp_path / "r.fq")).collect())) == [("@1", "AC", "+", "II"), ("@2", "GG", "+", "JJ")]
    (tmp_path / "p.pile").write_text("c\t1\tA\t2\t.,\nc\t2\tC\t1\t^].\n")
    assert [r.reads.fwd for r in formats.pileup(spark, str(tmp_path / "p.pile")).orderBy("pos").collect()] == [1, 1]


def test_codon_table_errors(spark):
    with pytest.raises(Exception, match="codon table"):
        codons.parse_codon_table(spark.createDataFrame([("nonsense",)], "value string")).collect()


def test_stream_equals_batch(spark, tmp_path):
    from helixspark.operators.variant_filter import filter_variants
    from helixspark.streaming.variants import filter_stream

    info = "DP=9;DP4=3,3,{},4;MQ=50"
    rows = [(c, p, r, a, float(q), info.format(p % 4)) for c in ("1", "2") for p, r, a, q in [(10, "A", "C", 20), (12, "A", "AT", 30), (14, "G", "T", 40), (30, "AC", "A", 9), (33, "C", "CA", 50), (90, "A", "T", 5)]]
    schema = "chr string, pos long, ref string, alt string, qual double, info string"
    batch = {(r.chr, r.pos): r.status for r in filter_variants(spark.createDataFrame(rows, schema)).collect()}
    for i, part in enumerate((rows[:3] + rows[6:8], rows[3:6] + rows[8:], [(c, 999, "N", "N", 0.0, "END") for c in ("1", "2")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in{i}"))
    import shutil

    (tmp_path / "in").mkdir()
    stream = filter_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    for i in range(3):
        for f in (tmp_path / f"in{i}").glob("part-*.json"):
            shutil.copy(f, tmp_path / "in" / f"{i}-{f.name}")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    found = {(r.chr, r.pos): r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == batch


def test_scar_found_in_two_ways():
    """A repeat that begins with one base nine times meets itself less a base as well."""
    r, m = "AAAAAAAAAATCAGTCGGACGAAGTCGTGG", "CGTTGCATGCAAGTCCTGACTTACGGATCTACGT"
    assert alignment.scar(r + m + r, 20, 60) == (True, r, None)
