"""The variant filter over a stream that is sorted by position within each chromosome.

State: the variants of a chromosome that later ones can still change. They leave once the stream has passed their reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vcf
from ..operators.variant_filter import Limits, judge

_FIELDS = ["pos", "ref", "alt", "qual", "alt_depth", "status"]


def filter_stream(variants: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """variants: a stream of chr, pos, ref, alt, qual, info. A stream of chr, pos, ref, alt, status, as they become final.

    An info of END closes the chromosome. An unsorted variant is an error, as its neighbours may be out already.
    """
    d = vcf.dp4("info")
    v = variants.select(
        "chr", F.col("pos").cast("long").alias("pos"), "ref", "alt", F.col("qual").cast("double").alias("qual"), F.coalesce(d["altfwd"] + d["altrev"], F.lit(0)).alias("alt_depth"),
        F.when(F.col("info") == "END", "END").otherwise(F.coalesce(vcf.hard_filter(d, vcf.map_quality("info"), vcf.pv4("info")), F.lit("DEPTH_TOO_LOW"))).alias("status"),
    )
    reach = max(limits.near, limits.far)
    out = T.StructType([variants.schema["chr"], *T._parse_datatype_string("pos long, ref string, alt string, status string").fields])
    state_type = "pos array<long>, ref array<string>, alt array<string>, qual array<double>, alt_depth array<long>, status array<string>"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame(dict(zip(_FIELDS, state.get, strict=True))) if state.exists else pd.DataFrame({c: [] for c in _FIELDS})
        new = pd.concat(list(frames)).sort_values(["pos", "ref", "alt"], kind="stable")
        ended = (new["status"] == "END").any()
        new = new[new["status"] != "END"]
        if len(new) and len(old) and new["pos"].min() < old["pos"].max():
            raise ValueError("variants must come in the order of their positions")
        rows = pd.concat([old, new[_FIELDS]], ignore_index=True) if len(old) else new[_FIELDS].reset_index(drop=True)
        rows["status"] = judge(rows, limits)
        last = rows["pos"].max() if len(rows) else 0
        stay = (rows["pos"] + rows["ref"].str.len() - 1 + reach >= last) & (not ended) if len(rows) else pd.Series([], dtype=bool)
        kept = rows[stay]
        if ended or not len(kept):
            if state.exists:
                state.remove()
        else:
            state.update(tuple(kept[c].tolist() for c in _FIELDS))
        done = rows[~stay]
        yield pd.DataFrame({"chr": [key[0]] * len(done), "pos": done["pos"].astype("int64"), "ref": done["ref"], "alt": done["alt"], "status": done["status"]})

    return v.groupBy("chr").applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.NoTimeout)
