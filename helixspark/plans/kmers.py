"""Indexes of canonical k-mers, and searches in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over all tasks: rows that become many each, as sequences do, often come in one small file."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def exploded(df: DataFrame, seq: str, k: int, *keys: str) -> DataFrame:
    """keys, pos and the digits of the canonical k-mer there. K-mers with letters other than ACGT are left out."""
    # Digits of both strands are made once for a sequence, before it is dealt; its k-mers are pieces of them.
    clean = F.col(seq).rlike("^[ACGT]*$").alias("__clean")
    both = dealt(df.select(*keys, F.col(seq).alias("__seq"), dna.kmer_digits(seq).alias("__plus"), F.reverse(F.translate(seq, "CTAG", "0123")).alias("__minus"), clean), *keys)
    found = F.transform(dna.positions(F.length("__seq") - k), lambda i: F.struct(i.alias("pos"), F.least(dna.substr("__plus", i, k), dna.substr("__minus", F.length("__minus") - k - i, k)).alias("kmer")))
    found = F.when(F.col("__clean"), found).otherwise(F.filter(found, lambda x: dna.substr("__seq", x["pos"], k).rlike("^[ACGT]+$")))
    return both.select(*keys, F.explode(found).alias("__k")).select(*keys, F.col("__k.pos").alias("pos"), F.col("__k.kmer").alias("kmer"))


def kmer_index(df: DataFrame, seq: str, k: int) -> DataFrame:
    """kmer, n, state: 1 for once, 2 for more often. Counts are pre-added before the shuffle, so a frequent k-mer is no hot spot."""
    return exploded(df, seq, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.least("n", F.lit(2)).cast("long"))


def kmer_search(queries: DataFrame, key: str, seq: str, index: DataFrame, k: int) -> DataFrame:
    """For each query the first offset whose canonical k-mer is indexed: key, result (ONCE, TWICE, NONE), pos (-1 for none).

    Both sides have many rows for each of their input, which Spark's sizes don't show, so that neither may be broadcast.
    """
    hits = exploded(queries, seq, k, key).join(index.select("kmer", "state").hint("merge"), "kmer").groupBy(key).agg(F.min(F.struct("pos", "state")).alias("hit"))
    result = F.when(F.col("hit.state") == 1, "ONCE").when(F.col("hit.state") == 2, "TWICE").otherwise("NONE")
    return queries.select(key).join(hits.hint("merge"), key, "left").select(key, result.alias("result"), F.coalesce(F.col("hit.pos"), F.lit(-1)).cast("long").alias("pos"))


def save_index(index: DataFrame, path: str, files: int = 64) -> None:
    """Write an index in ranges of its k-mers, so that a search for a few of them reads a few files."""
    index.repartitionByRange(files, "kmer").sortWithinPartitions("kmer").write.parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Letters of a suffix that an index keeps.
SUFFIX = 64


def suffixes(df: DataFrame, key: str, text: str, length: int = SUFFIX) -> DataFrame:
    """key, pos, suffix: the suffixes of texts, cut to a length; sorted by suffix they are a suffix array."""
    at = F.explode(dna.positions(F.length(text) - 1)).alias("pos")
    return df.select(key, text, at).select(key, "pos", dna.substr(text, F.col("pos"), length).alias("suffix"))


def find_all(index: DataFrame, queries: DataFrame, key: str, query: str = "query", length: int = SUFFIX) -> DataFrame:
    """query, key, pos of all occurrences of queries, however long. index: of suffixes() with the same length.

    A query is cut into blocks of that length. A block meets the suffixes that begin with it in an equi-join on its first letters, as many as
    the largest power of two that it has, and a query is where all its blocks are, one behind the other. Empty and null queries have no occurrence.
    """
    q = queries.select(query).distinct().filter(F.length(query) > 0)
    starts = F.sequence(F.lit(0), F.length(query) - 1, F.lit(length))
    blocks = q.select(query, F.size(starts).alias("__blocks"), F.explode(starts).alias("__at")).withColumn("__b", F.substring(query, F.col("__at") + 1, F.lit(length)))
    found = None
    n = 1
    while n <= length:
        own = blocks.filter(F.length("__b") >= n)
        own = own.filter(F.length("__b") < 2 * n) if 2 * n <= length else own
        own = own.withColumn("__s", F.substring("__b", 1, n))
        hits = index.withColumn("__s", F.substring("suffix", 1, n)).join(own, "__s").filter(F.startswith("suffix", F.col("__b")))
        hits = hits.select(query, key, "__blocks", (F.col("pos") - F.col("__at")).alias("pos"))
        found = hits if found is None else found.unionByName(hits)
        n *= 2
    return found.groupBy(query, key, "pos", "__blocks").agg(F.count(F.lit(1)).alias("__n")).filter("__n = __blocks").select(query, key, "pos")
