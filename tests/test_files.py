"""Files, indexes and SQL functions."""

from helixspark.functions import dna, sql
from helixspark.plans import kmers
from helixspark.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "b.csv").write_text("z")
    assert [x.rpartition("/")[2] for x in files.files_ending_with(spark, str(tmp_path), [".txt", ".tab"])] == ["a.txt"]
    assert files.count_lines(spark, str(tmp_path / "a.txt")) == 2
    ok, digest, messages = files.copy_verified(spark, str(tmp_path / "a.txt"), str(tmp_path / "c.txt"))
    assert ok and digest and not messages and (tmp_path / "c.txt").read_text() == "x\ny\n"
    assert not files.copy_verified(spark, str(tmp_path / "none"), str(tmp_path / "d"))[0]
    assert files.piped_lines(spark, ["a\n", "b"]).count() == 2


def test_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "BANANAS"), (2, "ANA")], "id long, text string")
    index = kmers.suffixes(df, "id", "text")
    got = kmers.find_all(index, spark.createDataFrame([("ANA",), ("S",), ("Q",)], "query string"), "id")
    assert sorted(map(tuple, got.collect())) == [("ANA", 1, 1), ("ANA", 1, 3), ("ANA", 2, 0), ("S", 1, 6)]
    kmers.save_index(kmers.kmer_index(spark.createDataFrame([("ACGTACGTAA",)], "seq string"), "seq", 8), str(tmp_path / "ix"), 2)
    assert kmers.load_index(spark, str(tmp_path / "ix")).count() == 3


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT revcomp('AACG') AS r, gc_content('GGAT') AS g, codon_aa('atg') AS a, wrap60(repeat('A', 61)) AS w, variant_kind('A', 'AT') AS k, canonical_kmer('GATC') AS c").first()
    assert (row.r, row.g, row.a, row.w, row.k) == ("CGTT", 0.5, "M", "A" * 60 + "\nA", "INDEL")
    assert row.c == spark.range(1).select(dna.canonical_kmer(dna.F.lit("GATC"))).first()[0]
