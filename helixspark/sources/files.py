"""Files: listing by suffix, line counts, copies verified by checksums; all through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import checksums


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def files_ending_with(spark: SparkSession, folder: str, suffixes: list[str]) -> list[str]:
    """Paths of the files in a folder that end in one of the suffixes, sorted."""
    fs, p = _fs(spark, folder)
    return sorted(str(x.getPath().toString()) for x in fs.listStatus(p) if x.isFile() and str(x.getPath().getName()).endswith(tuple(suffixes)))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def copy_verified(spark: SparkSession, source: str, target: str) -> tuple[bool, str | None, list[str]]:
    """Copy a file and compare both sides' checksums: ok, the checksum, messages. A copy that differs is deleted."""
    (a, p), (b, q) = _fs(spark, source), _fs(spark, target)
    if not a.exists(p):
        return False, None, [f"{source} doesn't exist"]
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, spark._jsc.hadoopConfiguration())
    one, two = (checksums(spark, x).first().md5 for x in (source, target))
    if one != two:
        b.delete(q, False)
        return False, None, [f"checksums differ: {one} and {two}"]
    return True, one, []


def piped_lines(spark: SparkSession, lines) -> DataFrame:
    """Lines that the driver has, such as those of its standard input, as a table of value."""
    return spark.createDataFrame([(x.rstrip("\n"),) for x in lines], "value string")


def cell(df: DataFrame, order: str, row: int, column: str) -> DataFrame:
    """A single cell of a table as a one-row table: the row-th by order, from 0."""
    from pyspark.sql import Window

    return df.withColumn("__n", F.row_number().over(Window.orderBy(order)) - 1).filter(F.col("__n") == row).select(column)
