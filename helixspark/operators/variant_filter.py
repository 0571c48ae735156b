"""Neighbourhood filter of variants: hard filters are Columns, and what depends on order runs over position-sorted rows.

A variant only acts on those within the window, so a chromosome is cut into runs that are further apart than the window. Runs
are found by ranges of positions, with the furthest reach carried from range to range, and each is read as a stream that
holds the variants within the window and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vcf

#: Positions of a range.
RANGE = 1 << 16


@dataclass(frozen=True)
class Limits:
    """Bases around an indel within which others fail (near), and within which indels compete (far)."""

    near: int = 3
    far: int = 10


class Staging:
    """The variants that later ones can still change. Statuses come out once they are final."""

    def __init__(self, limits: Limits = Limits()):
        self.limits, self.held = limits, []

    def push(self, key, pos: int, ref: str, alt: str, qual: float, alt_depth: int, status: str) -> list[tuple]:
        """Take the next variant, whose status is that of the hard filters; returns key and status of those that it is beyond."""
        near, far = self.limits.near, self.limits.far
        done = [(x[0], x[4]) for x in self.held if x[1] + max(near, far) < pos]
        self.held = [x for x in self.held if x[1] + max(near, far) >= pos]
        indel, score = len(ref) != len(alt), int(qual) * 1000 + int(alt_depth)
        if status == "PASS":
            # All that passed so far and lies within the window is looked at before anything is decided.
            passed = [x for x in self.held if x[4] == "PASS"]
            rivals = [x for x in passed if x[2] == indel and x[1] + (far if indel else 0) >= pos]
            others = [x for x in passed if x[2] != indel and x[1] + near >= pos]
            for x in rivals:
                if x[3] <= score:
                    x[4] = "BETTER_NEIGHBORING_MUTATION"
            beaten = any(x[3] > score for x in rivals)
            if indel:
                for x in others:
                    x[4] = "NEIGHBORING_INDEL"
                status = "BETTER_NEIGHBORING_MUTATION" if beaten else status
            elif beaten or others:
                status = "NEIGHBORING_INDEL"
        self.held.append([key, int(pos) + len(ref) - 1, indel, score, status])
        return done

    def flush(self) -> list[tuple]:
        done, self.held = [(x[0], x[4]) for x in self.held], []
        return done


def judge(rows: pd.DataFrame, limits: Limits = Limits()) -> list[str]:
    """Statuses of rows sorted by position. Columns: pos, ref, alt, qual, alt_depth, status (of the hard filters)."""
    staging, status = Staging(limits), rows["status"].tolist()
    done = []
    for i, x in enumerate(zip(rows["pos"], rows["ref"], rows["alt"], rows["qual"], rows["alt_depth"], rows["status"], strict=True)):
        done += staging.push(i, *x)
    for i, s in [*done, *staging.flush()]:
        status[i] = s
    return status


def _runs(v: DataFrame, reach: int) -> DataFrame:
    """v with __run: the first position of the run. Windows are over (chr, range); over chr there is a row for each range."""
    v = v.withColumn("__range", F.floor(F.col("pos") / RANGE)).withColumn("__end", F.col("pos") + F.length("ref") - 1)
    by_range = Window.partitionBy("chr").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("chr", "__range").orderBy("pos")

    def carried(df: DataFrame, value, name: str) -> DataFrame:
        """The largest value of all earlier ranges."""
        largest = df.groupBy("chr", "__range").agg(F.max(value).alias("__most"))
        return df.join(largest.select("chr", "__range", F.max("__most").over(by_range).alias(name)), ["chr", "__range"])

    v = carried(v, F.col("__end"), "__before")
    end = F.greatest("__before", F.max("__end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    v = v.withColumn("__cut", F.when(end.isNull() | (end + reach < F.col("pos")), F.col("pos")))
    v = carried(v, F.col("__cut"), "__last")
    v = v.withColumn("__run", F.greatest("__last", F.max("__cut").over(inside)))
    return v.drop("__range", "__end", "__before", "__cut", "__last")


def filter_variants(variants: DataFrame, limits: Limits = Limits(), **hard) -> DataFrame:
    """variants: chr, pos, ref, alt, qual, info. Adds status; rows that name no variant (ref N, alt .) are left out.

    Variants at one position are taken in the order of ref, alt, qual, info and the columns okey and line if there are any.
    """
    d = vcf.dp4("info")
    v = variants.filter("ref <> 'N' AND alt <> '.'").withColumn("status", F.coalesce(vcf.hard_filter(d, vcf.map_quality("info"), vcf.pv4("info"), **hard), F.lit("DEPTH_TOO_LOW")))
    v = v.withColumn("alt_depth", F.coalesce(d["altfwd"] + d["altrev"], F.lit(0)))
    order = [c for c in ("pos", "ref", "alt", "qual", "info", "okey", "line") if c in v.columns]
    names = v.columns
    runs = _runs(v, max(limits.near, limits.far)).repartition("chr", "__run").sortWithinPartitions("chr", "__run", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        staging, here = Staging(limits), None

        def out(done: list[tuple], ready: list[dict]) -> None:
            for row, status in done:
                row["status"] = status
                ready.append(row)

        schema = None
        for batch in batches:
            schema, ready = batch.select(names).schema, []
            for row in batch.to_pylist():
                if here != (row["chr"], row["__run"]):
                    out(staging.flush(), ready)
                    here = row["chr"], row["__run"]
                out(staging.push(row, row["pos"], row["ref"], row["alt"], row["qual"], row["alt_depth"], row["status"]), ready)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in ready], schema=schema)
        if schema is not None:
            ready = []
            out(staging.flush(), ready)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in ready], schema=schema)

    return runs.mapInArrow(run, v.schema)
