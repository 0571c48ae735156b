"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors, unless PYTHONPATH has it already."""
    if str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    sc = spark.sparkContext
    if getattr(sc, "_helixspark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="helixspark-ship-")
    archive = os.path.join(folder, "helixspark_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    path = list(sys.path)
    sc.addPyFile(archive)
    sys.path[:] = path  # the driver has the package already
    sc._helixspark_shipped = True
    atexit.register(shutil.rmtree, folder, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset, as in local tests, one of our own; an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_helixspark_shared", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), "checkpoints", f"helixspark-{uuid.uuid4().hex}")
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, True)
        found = spark.sparkContext._helixspark_shared = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths made since tidy() was entered, the innermost last.
_made: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is staged inside at its end, but for the staged tables that are handed to what it yields."""
    kept: list[str] = []
    _made.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._staged)
        return df

    try:
        yield keep
    finally:
        for path in _made.pop():
            if path not in kept:
                remove(spark, path)
            elif _made:
                _made[-1].append(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._staged)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, wherever that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_of(col: str) -> Column:
    """Text of a column, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def offsets(counts: DataFrame, key: str, n: str, out: str, width: int = 1024) -> DataFrame:
    """Sum of n over all smaller keys, by blocks of keys, so that no task holds more than max(keys / width, width) rows.

    key: distinct longs from 0.
    """
    from pyspark.sql import Window

    block = F.floor(F.col(key) / width)
    c = counts.withColumn("__block", block)
    sums = c.groupBy("__block").agg(F.sum(n).alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        c.join(sums, "__block")
        .withColumn(out, F.col("__before") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .drop("__block", "__before")
    )


#: Bits of one row of Spark's bitmap aggregate.
_BITMAP = 32768


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap_of(df: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """A bitmap of hashed keys: at most bits / 32768 rows of 4096 bytes, however many keys there are."""
    at = _bit(F.col(key), bits)
    return df.groupBy(F.floor(at / _BITMAP).alias("__bucket")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(_BITMAP)).cast("long")).alias("__bitmap"))


def bitmap_place(at: Column) -> tuple[Column, Column]:
    """Row and place in it of a bit of a bitmap."""
    return F.floor(at / _BITMAP), F.pmod(at, F.lit(_BITMAP)).cast("long")


def bit_set(bitmap: str, place: Column) -> Column:
    """Whether the bit of a row of a bitmap is set; not where there is no row."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))


def in_bitmap(df: DataFrame, key: str, bitmap: DataFrame, bits: int = 1 << 24, inside: bool = True) -> DataFrame:
    """Rows of df whose key's bit is set, or those whose key's isn't. What is broadcast is bounded by bits / 8 bytes."""
    at = _bit(F.col(key), bits)
    joined = df.withColumn("__bucket", F.floor(at / _BITMAP)).join(F.broadcast(bitmap), "__bucket", "inner" if inside else "left")
    is_set = bit_set("__bitmap", F.pmod(at, F.lit(_BITMAP)).cast("int"))
    return joined.filter(is_set if inside else ~is_set).drop("__bucket", "__bitmap")


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """Rows of docs whose identifier isn't in gone (column id). Only rows whose bit is set in a bitmap of gone are shuffled."""
    bitmap = bitmap_of(gone, "id")
    suspects = in_bitmap(docs, id_col, bitmap)
    stay = suspects.join(gone.select(F.col("id").alias("__gone")), F.col(id_col) == F.col("__gone"), "left_anti")
    return in_bitmap(docs, id_col, bitmap, inside=False).select(*docs.columns).unionByName(stay.select(*docs.columns))
