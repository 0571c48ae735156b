"""Exact dedup over a log-structured merge index, in DataFrame operations only.

Memtables hold at most so many entries, and each is flushed as a run: for each digest the row that stays and the number of
rows, sorted by digest. Compaction goes level by level. It merges FAN neighbouring runs into one and keeps the smallest (or
largest) identifier of a digest. Filters of fixed size say which digests other runs of the same group may hold; entries that
none of them holds pass into the new run as they are, and only the others are shuffled and merged. The last run is the whole
index. Its digests of more than one row are hits, and a filter of the hits is probed with every document: those outside are
single, those inside are looked up and verified by bytes. A hot digest is one entry in every memtable, so a group of copies
meets its verdict in as many parts as there are memtables, which grow in number with the input.

Byte verification compares all texts of a digest by the smallest and the largest of them, pre-aggregated in each task. If texts
under one digest differ (forced in the tests by short digests), the rows of that digest are grouped by the text.

Defined results: null text equals the empty text. Null identifiers stay only if a group has no other. Of repeated rows
(same identifier and text) of the identifier that stays, exactly one row is kept. Very long texts are hashed and compared whole.
An empty table gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_set, bitmap_of, bitmap_place, in_bitmap, scratch, staged, text_of, tidy

#: Entries of a memtable, memtables of a flush at most (beyond that they grow), and runs that one compaction merges.
MEMTABLE, MEMTABLES, FAN = 8192, 4096, 4


class DigestIndex:
    """Runs of entries (digest, keep, row, n): the identifier that stays, its row's number, and the number of rows.

    Further batches can be flushed at any time; compact() merges whatever runs there are into one.
    """

    def __init__(self, spark: SparkSession, keep: str = "min", path: str | None = None, memtable: int = MEMTABLE, filter_bits: int = 1 << 22):
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.spark, self.keep, self.path = spark, keep, path or scratch(spark, "digest-index")
        self.memtable, self.filter_bits = memtable, filter_bits
        #: Folders of runs that make up the index, and those that were flushed, each with its number of runs.
        self.runs: list[tuple[str, int]] = []
        self.flushed: list[tuple[str, int]] = []
        self.written = 0

    def order(self, key: str, row: str) -> Column:
        """What the best of a group has smallest, or largest: a null identifier is the worst, then the first row counts."""
        if self.keep == "min":
            return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("keep"), F.col(row).alias("row"))
        return F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("keep"), (-F.col(row)).alias("row"))

    def best(self, key: str, row: str) -> Column:
        return (F.min if self.keep == "min" else F.max)(self.order(key, row)).alias("best")

    def named(self, df: DataFrame) -> DataFrame:
        """best as the columns keep and row."""
        return df.withColumn("keep", F.col("best.keep")).withColumn("row", F.abs("best.row")).drop("best")

    def _write(self, entries: DataFrame, runs: int) -> tuple[str, int]:
        path = f"{self.path}/{self.written:05d}"
        self.written += 1
        entries.select("run", "digest", "keep", "row", "n").sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(path)
        return path, runs

    def flush(self, rows: DataFrame) -> int:
        """rows: id, row (a number of its own), digest. Returns the number of runs."""
        memtables = max(1, min(MEMTABLES, math.ceil(rows.count() / self.memtable)))
        dealt = rows.withColumn("run", memtable_of(memtables)).repartition("run")
        entries = self.named(dealt.groupBy("run", "digest").agg(self.best("id", "row"), F.count(F.lit(1)).alias("n")))
        kind = rows.schema["id"].dataType.simpleString()
        self.schema = f"digest binary, keep {kind}, row long, n long, run int"
        new = self._write(entries, memtables)
        self.runs.append(new)
        self.flushed.append(new)
        return memtables

    def entries(self, folders: list[tuple[str, int]] | None = None) -> DataFrame:
        """The entries of the runs, which are numbered through all folders."""
        out, before = None, 0
        for path, runs in self.runs if folders is None else folders:
            own = self.spark.read.schema(self.schema).parquet(path).withColumn("run", F.col("run") + before)
            out, before = own if out is None else out.unionByName(own), before + runs
        return out

    def _apart(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries whose digest no other run of their group may hold, and the rest. Column group is added.

        Runs differ in some binary digit of their place in the group. For each digit and value there is a filter of the digests of the runs that have
        it, and an entry is looked up in those of the digits that its own run hasn't.
        """
        entries = entries.withColumn("group", F.floor(F.col("run") / FAN).cast("int"))
        at = F.pmod(F.xxhash64("group", "digest"), F.lit(self.filter_bits))
        digits = range((FAN - 1).bit_length())
        digit = lambda i: F.pmod(F.floor(F.col("run") / (1 << i)), F.lit(2)).cast("int")
        bucket, place = bitmap_place(at)
        sides = F.explode(F.array(*(digit(i) + 2 * i for i in digits))).alias("side")
        filters = entries.select(sides, bucket.alias("bucket"), place.alias("place")).groupBy("side", "bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
        filters = staged(filters, "index-filters")
        probed = entries.withColumn("bucket", bucket).withColumn("place", place.cast("int")).withColumn("shared", F.lit(False))
        for i in digits:  # filter_bits / 8 bytes for each side
            other = filters.select(F.col("side"), F.col("bucket").alias("b"), "bitmap")
            probed = probed.join(F.broadcast(other), (F.col("side") == 2 * i + 1 - digit(i)) & (F.col("b") == F.col("bucket")), "left")
            probed = probed.withColumn("shared", F.col("shared") | bit_set("bitmap", F.col("place"))).drop("side", "b", "bitmap")
        probed = probed.drop("bucket", "place")
        return probed.filter(~F.col("shared")), probed.filter("shared")

    def compact(self) -> None:
        """Merge all runs into one, level by level, each level of all groups in one job."""
        while (runs := sum(n for _, n in self.runs)) > 1:
            alone, shared = self._apart(self.entries())
            merged = self.named(shared.groupBy("group", "digest").agg(self.best("keep", "row"), F.sum("n").alias("n")))
            columns = [F.col("group").alias("run"), "digest", "keep", "row", "n"]
            self.runs = [self._write(alone.select(*columns).unionByName(merged.select(*columns)), math.ceil(runs / FAN))]

    def hits(self) -> DataFrame:
        """run (of those flushed), digest, keep, row, n of digests that several rows have."""
        total = self.entries()
        if sum(n for _, n in self.runs) > 1:
            total = self.named(total.groupBy("digest").agg(self.best("keep", "row"), F.sum("n").alias("n")))
        total = staged(total.filter("n > 1").select("digest", "keep", "row", "n"), "index-hits")
        flushed = in_bitmap(self.entries(self.flushed).select("run", "digest"), "digest", bitmap_of(total, "digest"))
        return flushed.join(total, "digest").select("run", "digest", "keep", "row", "n")


def memtable_of(memtables: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", memtable: int = MEMTABLE, digest_bits: int = 256, filter_bits: int = 1 << 24) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    memtable: entries of a memtable. digest_bits: of the SHA-256, fewer only to test collisions. filter_bits: size of the
    broadcast filter of hits (2 MB), a multiple of 32768.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = rows.withColumn("digest", F.expr(f"substring(sha, 1, {digest_bits // 8})"))
    log = staged(rows.select("id", "sha", "digest").withColumn("row", F.monotonically_increasing_id()), "dedup-log")
    index = DigestIndex(spark, keep, memtable=memtable)
    memtables = index.flush(log.select("id", "row", "digest"))
    index.compact()
    hits = staged(index.hits(), "dedup-hits")
    hit = staged(bitmap_of(hits, "digest", filter_bits), "dedup-filter")

    # Byte verification: the texts of rows whose digest may be a hit, and no others, are shuffled, one or two for each task and digest.
    texts = in_bitmap(rows, "digest", hit, filter_bits).groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    unlike = staged(texts.filter("a <> b").select("digest"), "dedup-unlike")

    single = in_bitmap(log, "digest", hit, filter_bits, inside=False).select("id", "sha", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    asked = in_bitmap(log, "digest", hit, filter_bits).withColumn("run", memtable_of(memtables))
    found = asked.join(hits.withColumnRenamed("row", "best"), ["run", "digest"], "left")
    known = F.col("n").isNotNull()
    found = found.select(
        "id", "sha", "digest", F.when(known, F.col("keep")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (~known | (F.col("row") == F.col("best"))).alias("kept")
    )
    found = single.unionByName(found)
    if not unlike.isEmpty():
        inside = staged(rows.join(unlike, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "dedup-inside")
        groups = index.named(inside.groupBy("digest", "text").agg(index.best("id", "row"), F.count(F.lit(1)).alias("group_size"))).withColumnRenamed("row", "best")
        split = inside.join(groups, ["digest", "text"]).select("id", "sha", "digest", F.col("keep").alias("keep_id"), "group_size", (F.col("row") == F.col("best")).alias("kept"))
        found = found.join(unlike, "digest", "left_anti").unionByName(split)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """docs without the rows that exact_dedup() drops, all columns kept. Only rows of groups are shuffled.

    Repeated rows of the identifier that stays are told apart by a number within (identifier, digest).
    """
    with tidy(docs.sparkSession) as last:
        groups = exact_dedup(docs, id_col, text_col, keep, **options).filter("group_size > 1")
        marks = groups.select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__key"), F.col("kept").alias("__kept"))
        marks = last(staged(marks.groupBy("__id", "__key").agg(F.max("__kept").alias("__kept")), "dedup-marks"))
    named = docs.withColumn("__key", F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)))
    bitmap = bitmap_of(marks, "__key")
    single = in_bitmap(named, "__key", bitmap, inside=False)
    suspects = in_bitmap(named, "__key", bitmap)
    found = suspects.join(marks.withColumnRenamed("__key", "__sha"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha")), "left")
    again = F.row_number().over(Window.partitionBy("__key", id_col).orderBy(F.lit(0)))
    stay = found.filter("__kept IS NULL OR __kept").withColumn("__again", again).filter("__kept IS NULL OR __again = 1")
    return single.select(*docs.columns).unionByName(stay.select(*docs.columns))
