"""Oligo design: all windows of a template scored in one plan, the best one, growth from the start, and a ladder of relaxed limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dna
from ..functions.thermo import Params
from . import windows
from .kmers import dealt


_FOUND = "l int, n int, oligo string, tm double, penalty double"


def _scored(templates: DataFrame, target: float | Column, key: str, seq: str, p: Params, penalties: str | None, more: str, pick: Callable) -> DataFrame:
    """key, _FOUND and more columns of the windows that pick(block, rows, l, n, tm, penalty, target) takes: their places and the columns' values."""
    target = target if isinstance(target, Column) else F.lit(target)
    own = F.col(penalties).cast("array<double>") if penalties else F.lit(None).cast("array<double>")
    rows = dealt(templates.select(key, F.col(seq).alias("__seq"), target.cast("double").alias("__target"), own.alias("__own")), key)
    schema = T.StructType([templates.schema[key], *T._parse_datatype_string(_FOUND + more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, 4096) for x in batches for at in range(0, x.num_rows, 4096)):
            target, own = batch.column(2).to_numpy(zero_copy_only=False).astype(float), batch.column(3).to_pylist()
            for place, block in windows.blocks(batch.column(1).to_pylist(), lambda n: len(windows.spans(n, p)[0])):
                rows, l, n, tm, penalty = windows.chosen(block, target[place], [own[i] for i in place], p)
                took, values = pick(block, rows, l, n, tm, penalty, target[place])
                rows, l, n = rows[took], l[took], n[took]
                bases = windows.texts_of(block, rows, l, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place[rows])), pa.array(l, pa.int32()), pa.array(n, pa.int32()), bases, pa.array(tm[took]), pa.array(penalty[took]), *values], names=schema.names)

    return rows.mapInArrow(run, schema)


def candidates(templates: DataFrame, target: float | Column, key: str = "id", seq: str = "seq", p: Params = Params(), penalties: str | None = None) -> DataFrame:
    """key, l, n, oligo, tm, penalty of the windows that may do: near the target temperature, without CCCC.

    target: degrees, or a column of templates as F.col. penalties: a column with a number for each base, whose mean over the window is added.
    """
    return _scored(templates, target, key, seq, p, penalties, "", lambda block, rows, *_: (slice(None), []))


def best_candidates(templates: DataFrame, target: float | Column, key: str = "id", seq: str = "seq", p: Params = Params(), penalties: str | None = None) -> DataFrame:
    """best() of all candidates(): each template's windows are compared where they are made."""
    pick = lambda block, rows, l, n, tm, penalty, target: (windows.first_of(rows, np.round(penalty, 9), l, n), [])
    return best(_scored(templates, target, key, seq, p, penalties, "", pick), key)


def best(found: DataFrame, key: str = "id") -> DataFrame:
    """The candidate of the smallest penalty; the first by (l, n) among equals."""
    top = F.min(F.struct(F.round("penalty", 9).alias("penalty"), "l", "n", "oligo", "tm")).alias("b")
    return found.groupBy(key).agg(top).select(key, "b.*")


def grown(templates: DataFrame, target: float | Column, key: str = "id", seq: str = "seq", p: Params = Params()) -> DataFrame:
    """key, oligo, tm: grown from the template's start until the target is reached, or the template ends.

    Of the last two lengths the nearer to the target counts, then the end is moved to the next stable G or C in the direction that
    changes the temperature less, if that costs at most the penalty of an A or T. Where the target isn't reached within the
    longest length, that length is taken. Templates of one base have none.
    """
    target = target if isinstance(target, Column) else F.lit(target)
    rows = dealt(templates.select(key, F.upper(seq).alias("__seq"), target.cast("double").alias("__target")), key)
    schema = T.StructType([templates.schema[key], *T._parse_datatype_string("oligo string, tm double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, 4096) for x in batches for at in range(0, x.num_rows, 4096)):
            texts, target = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            oligos, degrees = [None] * len(texts), np.full(len(texts), np.nan)
            for place, block in windows.blocks(texts, lambda n: min(n, p.max_length)):
                if block.size > 1:
                    n, tm = windows.grown(block, target[place], p)
                    degrees[place] = tm
                    for i, size in zip(place, n, strict=True):
                        oligos[i] = texts[i][:size]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(oligos, pa.string()), pa.array(degrees, mask=np.isnan(degrees))], names=schema.names)

    return rows.mapInArrow(run, schema)


def designed(tasks: DataFrame, key: str = "id", p: Params = Params(), compromise: bool = False) -> DataFrame:
    """tasks: key, seq, align (LEFT, RIGHT, CENTERLEFT, CENTERRIGHT), strand (TOP, BOTTOM), offset, target, penalties (array of
    doubles, or null). A row per task: key, oligo, tm, offset, note; oligo is null where there is no design.

    Tasks of the bottom strand are those of the reverse complement with the other side's anchor, and their offsets count
    backwards. What then is anchored at the right can't be designed, nor a bottom task at the centre's left; the note says so.
    compromise: centred designs go down the ladder of limits.
    """
    bottom = F.col("strand") == "BOTTOM"
    swapped = F.create_map(*(F.lit(x) for x in ("LEFT", "RIGHT", "RIGHT", "LEFT", "CENTERRIGHT", "CENTERLEFT")))
    s = F.upper("seq")
    t = tasks.select(
        key, F.when(bottom, dna.revcomp(s)).otherwise(s).alias("seq"), F.when(bottom, F.try_element_at(swapped, F.col("align"))).otherwise(F.col("align")).alias("align"), bottom.alias("bottom"), "offset", F.col("target").cast("double").alias("target"),
        F.when(bottom, F.reverse("penalties")).otherwise(F.col("penalties")).alias("penalties"),
    )
    left = grown(t.filter("align = 'LEFT'"), F.col("target"), key, "seq", p).select(key, "oligo", "tm", F.lit(0).alias("l"))
    centre = t.filter("align = 'CENTERLEFT'")
    if compromise:
        found = compromised(centre, F.col("target"), key, "seq", p, "penalties")
    else:
        found = best_candidates(centre, F.col("target"), key, "seq", p, "penalties")
    every = left.unionByName(found.select(key, "oligo", "tm", "l"))
    note = F.when(F.col("align").isNull() | ~F.col("align").isin("LEFT", "CENTERLEFT"), "this anchor can't be designed on this strand").when(F.col("oligo").isNull(), "no design within the limits").otherwise("")
    at = F.when(F.col("bottom"), F.col("offset") - F.col("l")).otherwise(F.col("offset") + F.col("l"))
    return t.join(every, key, "left").select(key, "oligo", "tm", at.cast("long").alias("offset"), note.alias("note"))


def ladder(gc: str, p: Params) -> list[Params]:
    """Parameter sets from strict to mild for templates of low, medium or high GC."""
    steps = [p]

    def walk(field: str, values) -> None:
        for v in values:
            steps.append(replace(steps[-1], **{field: v}))

    lengths, spans = range(p.min_length - 1, 17, -1), range(int(p.tm_max_difference) + 1, 11)
    if gc == "high":
        walk("min_length", lengths)
        walk("tm_max_difference", map(float, spans))
    else:
        walk("tm_max_difference", map(float, spans))
        if gc == "medium":
            walk("min_length", lengths)
        walk("max_length", range(p.max_length + 1, 31))
    return steps


def compromised(templates: DataFrame, target: float | Column, key: str = "id", seq: str = "seq", p: Params = Params(), penalties: str | None = None) -> DataFrame:
    """The best candidate under the first step of the ladder that has any. All windows are scored once where they are made; steps are filters on them."""
    loose = replace(p, min_length=18, tm_max_difference=10.0, max_length=max(p.max_length, 30))
    steps = [ladder(gc, p) for gc in ("low", "medium", "high")]

    def pick(block: windows.Block, rows, l, n, tm, penalty, target):
        gc = np.isin(block.points, [ord(c) for c in "GCgc"]).sum(axis=1) / block.size
        regime = np.where(gc < 0.4, 0, np.where(gc > 0.6, 2, 1))[rows]
        step = np.full(len(rows), -1)
        for i, own in enumerate(steps):
            for j, q in reversed(list(enumerate(own))):
                step[(regime == i) & (n >= q.min_length) & (n <= q.max_length) & (np.abs(tm - target[rows]) <= q.tm_max_difference)] = j
        some = np.flatnonzero(step >= 0)
        took = some[windows.first_of(rows[some], step[some], np.round(penalty[some], 9), l[some], n[some])]
        return took, [pa.array(step[took], pa.int32())]

    found = _scored(templates, target, key, seq, loose, penalties, ", step int", pick)
    # Repeated keys have a row each until here.
    top = F.min(F.struct("step", F.round("penalty", 9).alias("__penalty"), "l", "n", "oligo", "tm", "penalty")).alias("b")
    return found.groupBy(key).agg(top).select(key, "b.step", "b.l", "b.n", "b.oligo", "b.tm", "b.penalty")
