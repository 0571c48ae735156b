"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly into buckets that fit in memory, by a seeded hash; pass two shuffles each bucket
by Fisher-Yates, gives its rows their places and writes them. The places of all buckets follow each other, so a row's global place,
and with it shard and slot, is its place in the bucket plus the rows of all earlier buckets. Law: counts of shards are
at most one apart.

The result depends on seed, identifiers, texts and their number only. Rows equal in identifier and text share a bucket;
where that makes a bucket larger than four times its bound, the bucket is split by the rows' places in the input, and
its order then depends on the input's files as well.

Defined results: null text has no bytes; null identifiers are hashed with their text. Very long texts are rows like others; a bucket
holds whole rows. An empty table gives an empty
result with the same columns. Extra columns are carried along; columns named shard or slot are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import offsets, ship, staged, text_of

#: Bytes that any record takes besides its text.
OVERHEAD = 16
#: Buckets at least, so that small inputs are spread as well.
LEAST_BUCKETS = 256


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of 0..n-1."""
    order = list(range(n))
    if n > 1:
        rng = np.random.default_rng(seed)
        draws = rng.integers(0, np.arange(n, 1, -1)).tolist()
        for i, j in zip(range(n - 1, 0, -1), draws, strict=True):
            order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shard_of(place: np.ndarray, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global places: the first total % shards shards have a row more."""
    least, more = divmod(total, shards)
    edge = more * (least + 1)
    low = place < edge
    shard = np.where(low, place // (least + 1), more + (place - edge) // max(least, 1))
    slot = np.where(low, place % (least + 1), (place - edge) % max(least, 1))
    return shard, slot


def shard_documents(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20) -> DataFrame:
    """docs with shard int and slot long."""
    ship(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    text = text_of(text_col)
    rows = docs.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id_col), text)).withColumn("__bytes", F.octet_length(text) + OVERHEAD)
    total, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.col("__bytes").cast("long"))).first()
    buckets = max(LEAST_BUCKETS, math.ceil((n_bytes or 0) / bucket_bytes))
    rows = rows.withColumn("__key", F.pmod(F.col("__hash"), F.lit(buckets)))
    sizes = rows.groupBy("__key").agg(F.sum(F.col("__bytes").cast("long")).alias("__b"))
    hot = sizes.filter(F.col("__b") > 4 * bucket_bytes).withColumn("__parts", F.ceil(F.col("__b") / bucket_bytes))
    parts = hot.agg(F.max("__parts")).first()[0] or 1
    if parts > 1:
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("__parts", F.lit(1)))
        rows = rows.join(hot.select("__key", "__parts"), "__key", "left").withColumn("__key", F.col("__key") * parts + place).drop("__parts")
        rows = staged(rows, "shards-split")  # places in the input must be the same for the counts and for the rows
    rows = rows.drop("__bytes")
    starts = offsets(rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")), "__key", "__n", "__start").select(F.col("__key").alias("__bucket"), "__start")
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = docs.columns

    def shuffled(key, left, right):
        number = key[0].as_py()
        left = left.take(pa.compute.sort_indices(left["__hash"]))  # an order that doesn't depend on the order of arrival
        left = left.take(pa.array(fisher_yates(left.num_rows, [seed & (2**63 - 1), number])))
        place = right["__start"][0].as_py() + np.arange(left.num_rows, dtype=np.int64)
        shard, slot = shard_of(place, total, shards)
        out = left.select(names)
        return out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    return rows.groupBy("__key").cogroup(starts.groupBy("__bucket")).applyInArrow(shuffled, schema)


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write each bucket's rows to the shards that they fall into, as folders shard=N of Parquet files; returns what is written.

    A bucket lies in one shard or in neighbouring ones, so a task writes few files. Slots give the order within a shard.
    """
    sharded.write.partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path).select(*sharded.columns)
