"""Ordered concatenation and ranking."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concat_ordered(df: DataFrame, group: str, order: str, text: str, sep: str = "") -> DataFrame:
    """group and the texts of its rows, concatenated in order. A group's text is one value, so it must fit in memory."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(group).agg(F.array_join(F.transform(rows, lambda x: x[text]), sep).alias(text))


def ranked(df: DataFrame, keys: list[Column]) -> DataFrame:
    """All rows with their rank from 1 by the keys, which should be distinct.

    Rows are dealt by ranges and sorted, numbered within their range, and moved by the sizes of the ranges before; one task sees
    one range, and one row for each range. Ranges are drawn by a sample, so the numbered rows are kept before they are counted.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():  # local tests; elsewhere spark.checkpoint.dir is set
        own = tempfile.mkdtemp(prefix="helixspark-ranks-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number holds the range in its upper bits and the place within it in the 33 lower ones.
    kept = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1)
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    rows = kept.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(sizes), "__part")
    return rows.withColumn("rank", (F.col("__before") + place + 1).cast("long")).drop("__part", "__at", "__before")
