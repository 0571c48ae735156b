"""Sequences, features and variants derived from the keys of the star schema, which has no nucleotides of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

_HEX, _BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna32(key: Column) -> Column:
    """32 bases from the digest of a key."""
    return F.translate(F.md5(key.cast("string").cast("binary")), _HEX, _BASES)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq: 64 bases for each part."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat(dna32(k), dna32(k + 1_000_000)).alias("seq"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, seq: 1,024 bases for each supplier."""
    k = F.col("s_suppkey").cast("string")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: dna32(F.concat(k, F.lit(":"), i.cast("string"))))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chr"), F.array_join(tiles, "").alias("seq"))


def primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """primer_id, chr, primer: 20 bases of a chromosome for each part, odd ones from the other strand."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 900).cast("int").alias("at"))
    n = F.broadcast(table(spark, sf_dir, "supplier").agg(F.min("s_suppkey").alias("lo"), F.count(F.lit(1)).alias("n")))  # one row
    placed = p.crossJoin(n).withColumn("chr", F.col("lo") + F.col("p_partkey") % F.col("n"))
    joined = placed.join(genome(spark, sf_dir).hint("merge"), "chr")  # by its file the genome looks small enough to broadcast
    window = dna.substr("seq", F.col("at"), 20)
    return joined.select(F.col("p_partkey").alias("primer_id"), "chr", F.when(F.col("p_partkey") % 2 == 1, dna.revcomp(window)).otherwise(window).alias("primer"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chr, l, r, fwd, type, gene, description."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    left = (k * 7) % 100_000
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (c % 16).alias("chr"), left.alias("l"), (left + c % 500).alias("r"), (k % 2 == 0).alias("fwd"),
        F.when(F.col("o_orderstatus") == "F", "ORF").when(F.col("o_orderstatus") == "O", "CDS").otherwise("intron").alias("type"),
        F.concat(F.lit("G"), (k % 997).cast("string")).alias("gene"), F.col("o_orderpriority").alias("description"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, chr, pos."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), (F.col("user_id") % 16).alias("chr"), ((F.col("event_id") * 13) % 100_000).alias("pos"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, pos, ref, alt, qual, info."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    seq = dna32(k * 10 + n)
    num = lambda x: x.cast("string")
    p = F.col("l_partkey")
    info = F.concat(
        F.lit("DP="), num(p % 90 + 1), F.lit(";DP4="), num(p % 11), F.lit(","), num(p % 7), F.lit(","), num(k % 13), F.lit(","), num(k % 5),
        F.lit(";MQ="), num(k % 60), F.when(n % 2 == 0, F.concat(F.lit(";PV4=0.5,1e-"), num(p % 120), F.lit(",0.25,"), num(n), F.lit("e-3"))).otherwise(F.lit("")),
    )
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 16).alias("chr"), ((k * 5) % 100_000).alias("pos"), k.alias("okey"), n.alias("line"),
        F.substring(seq, F.lit(1), (n % 3 + 1).cast("int")).alias("ref"), F.substring(seq, F.lit(9), (k % 3 + 1).cast("int")).alias("alt"), F.col("l_quantity").alias("qual"), info.alias("info"),
    )


# The same relations as DuckDB common table expressions, for the oracles.
_DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


def sql_dna32(key: str) -> str:
    return _DNA.format(key)


def sql_revcomp(s: str) -> str:
    return _RC.format(s)


SQL = {
    "seqs": f"seqs AS (SELECT p_partkey AS id, {sql_dna32('p_partkey')} || {sql_dna32('p_partkey + 1000000')} AS seq FROM part)",
    "genome": f"genome AS (SELECT s_suppkey AS chr, array_to_string(list_transform(range(32), lambda i: {sql_dna32('s_suppkey || chr(58) || i')}), '') AS seq FROM supplier)",
    "primers": f"""primers AS (SELECT p_partkey AS primer_id, g.chr, CASE WHEN p_partkey % 2 = 1 THEN {sql_revcomp('substr(g.seq, p_partkey % 900 + 1, 20)')} ELSE substr(g.seq, p_partkey % 900 + 1, 20) END AS primer
        FROM part, (SELECT min(s_suppkey) AS lo, count(*) AS n FROM supplier) AS s, genome AS g WHERE g.chr = s.lo + p_partkey % s.n)""",
    "features": """features AS (SELECT o_orderkey AS id, o_custkey % 16 AS chr, (o_orderkey * 7) % 100000 AS l, (o_orderkey * 7) % 100000 + o_custkey % 500 AS r, o_orderkey % 2 = 0 AS fwd,
        CASE o_orderstatus WHEN 'F' THEN 'ORF' WHEN 'O' THEN 'CDS' ELSE 'intron' END AS type, 'G' || (o_orderkey % 997) AS gene, o_orderpriority AS description FROM orders)""",
    "points": "points AS (SELECT event_id AS point_id, user_id % 16 AS chr, (event_id * 13) % 100000 AS pos FROM events)",
    "variants": f"""variants AS (SELECT l_suppkey % 16 AS chr, (l_orderkey * 5) % 100000 AS pos, l_orderkey AS okey, l_linenumber AS line, substr(s, 1, l_linenumber % 3 + 1) AS ref, substr(s, 9, l_orderkey % 3 + 1) AS alt, l_quantity AS qual,
        'DP=' || (l_partkey % 90 + 1) || ';DP4=' || (l_partkey % 11) || ',' || (l_partkey % 7) || ',' || (l_orderkey % 13) || ',' || (l_orderkey % 5) || ';MQ=' || (l_orderkey % 60)
        || CASE WHEN l_linenumber % 2 = 0 THEN ';PV4=0.5,1e-' || (l_partkey % 120) || ',0.25,' || l_linenumber || 'e-3' ELSE '' END AS info
        FROM (SELECT *, {sql_dna32('l_orderkey * 10 + l_linenumber')} AS s FROM lineitem))""",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
