"""Banded alignment, pileup strings, loop-out scars and clusters of matches."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dna import _c


@dataclass(frozen=True)
class Scores:
    """The scores of an alignment."""

    match: int = 40
    mismatch: int = -10
    open: int = -40
    extend: int = -1


def diagonal(a: str, b: str, k: int) -> int | None:
    """The usual offset of b's words of k letters in a; the smallest among equals, None without a common word."""
    last = {a[i : i + k]: i for i in range(len(a) - k)}
    votes = Counter(last[w] - j for j in range(len(b) - k) if (w := b[j : j + k]) in last)
    return min(votes, key=lambda d: (-votes[d], d)) if votes else None


def align(a: str, b: str, k: int = 10, width: int = 24, scores: Scores = Scores()) -> tuple[bool, str, str, int]:
    """Global alignment within a band of that width around the usual diagonal, with affine gaps: aligned, rows a and b, score.

    Bases that one sequence has beyond the other's end stand against gaps and cost nothing.
    """
    shift = diagonal(a, b, k)
    if shift is None:
        return False, a, b, 0
    n, m, half = len(a), len(b), width // 2
    low = -(10**9)
    # Rows are b's letters; columns are a's letters within the band. Three layers: pair, gap in a (up), gap in b (left).
    score = np.full((3, m + 1, width + 1), low, dtype=np.int64)
    back = np.zeros((3, m + 1, width + 1), dtype=np.int8)
    start = lambda y: y + shift - half  # noqa: E731  # a's prefix length at column 0 of row y
    for y in range(m + 1):
        for x in range(width + 1):
            i = start(y) + x
            if not 0 <= i <= n:
                continue
            if y == 0 or i == 0:  # free ends
                score[0, y, x] = 0
                back[0, y, x] = 3
                continue
            before = score[:, y - 1, x]
            best = int(before.argmax())
            score[0, y, x] = before[best] + (scores.match if a[i - 1] == b[y - 1] else scores.mismatch)
            back[0, y, x] = best
            if x < width:
                up = (score[0, y - 1, x + 1] + scores.open, score[1, y - 1, x + 1] + scores.extend, score[2, y - 1, x + 1] + scores.open)
                back[1, y, x] = int(np.argmax(up))
                score[1, y, x] = max(up)
            if x > 0:
                left = (score[0, y, x - 1] + scores.open, score[1, y, x - 1] + scores.open, score[2, y, x - 1] + scores.extend)
                back[2, y, x] = int(np.argmax(left))
                score[2, y, x] = max(left)
    ends = [(score[s, y, x], -s, y, x) for s in range(3) for y in range(m + 1) for x in range(width + 1) if 0 <= (i := start(y) + x) <= n and (y == m or i == n)]
    value, s, y, x = max(ends)
    s, i = -s, start(y) + x
    row_a, row_b = [a[i:][::-1], "-" * (m - y)], ["-" * (n - i), b[y:][::-1]]
    while not (s == 0 and back[0, y, x] == 3):
        s, was = int(back[s, y, x]), s
        if was == 0:
            y, i = y - 1, i - 1
            row_a.append(a[i])
            row_b.append(b[y])
        elif was == 1:
            y, x = y - 1, x + 1
            row_a.append("-")
            row_b.append(b[y])
        else:
            x, i = x - 1, i - 1
            row_a.append(a[i])
            row_b.append("-")
    row_a += [a[:i][::-1], "-" * y]
    row_b += ["-" * i, b[:y][::-1]]
    return True, "".join(row_a)[::-1], "".join(row_b)[::-1], int(value)


#: Pairs of equal lengths and diagonals that are aligned in one step.
LANES = 1024


def align_all(a: list[str], b: list[str], k: int = 10, width: int = 24, scores: Scores = Scores()) -> list[tuple[bool, str, str, int]]:
    """align() of each pair; pairs of the same lengths and diagonal go through the band together."""
    out: list = [None] * len(a)
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        shift = diagonal(x, y, k)
        if shift is None:
            out[i] = False, x, y, 0
        else:
            groups.setdefault((len(x), len(y), shift), []).append(i)
    for (_, _, shift), own in groups.items():
        for at in range(0, len(own), LANES):
            part = own[at : at + LANES]
            for i, row in zip(part, _lanes([a[i] for i in part], [b[i] for i in part], shift, width, scores), strict=True):
                out[i] = row
    return out


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), -1)


def _lanes(a: list[str], b: list[str], shift: int, width: int, scores: Scores) -> list[tuple[bool, str, str, int]]:
    """align() of pairs of one pair of lengths and one diagonal, cell by cell over all of them."""
    count, n, m, half, low = len(a), len(a[0]), len(b[0]), width // 2, -(10**9)
    pa_, pb = _points(a), _points(b)
    back = np.zeros((3, m + 1, width + 1, count), dtype=np.int8)
    start = lambda y: y + shift - half
    ends: dict[tuple[int, int, int], np.ndarray] = {}
    prior = None
    for y in range(m + 1):
        now = np.full((3, width + 1, count), low, dtype=np.int64)
        columns = [x for x in range(width + 1) if 0 <= start(y) + x <= n]
        free = [x for x in columns if y == 0 or start(y) + x == 0]
        inner = [x for x in columns if not (y == 0 or start(y) + x == 0)]
        for x in free:
            now[0, x] = 0
            back[0, y, x] = 3
        if inner:
            c, d = inner[0], inner[-1] + 1
            before = prior[:, c:d]
            best = before.argmax(axis=0)
            pair = pa_[:, start(y) + c - 1 : start(y) + d - 1].T == pb[:, y - 1]
            now[0, c:d] = before.max(axis=0) + np.where(pair, scores.match, scores.mismatch)
            back[0, y, c:d] = best
            top = min(d, width)
            if c < top:
                up = prior[:, c + 1 : top + 1] + np.array([scores.open, scores.extend, scores.open])[:, None, None]
                back[1, y, c:top] = up.argmax(axis=0)
                now[1, c:top] = up.max(axis=0)
            step = np.array([scores.open, scores.open, scores.extend])[:, None]
            for x in range(max(c, 1), d):
                left = now[:, x - 1] + step
                back[2, y, x] = left.argmax(axis=0)
                now[2, x] = left.max(axis=0)
        for x in columns:
            if y == m or start(y) + x == n:
                for s in range(3):
                    ends[s, y, x] = now[s, x].copy()
        prior = now
    places = sorted(ends, key=lambda e: (e[0], -e[1], -e[2]))
    table = np.stack([ends[e] for e in places])
    first = table.argmax(axis=0)
    value = table.max(axis=0)
    s, y, x = np.array(places)[first].T.copy()
    i = start(y) + x
    end_i, end_y = i.copy(), y.copy()
    lane = np.arange(count)
    gap = ord("-")
    row_a, row_b = (np.full((count, n + m), gap, dtype=np.uint32) for _ in range(2))
    length = np.zeros(count, dtype=np.int64)
    while True:
        going = ~((s == 0) & (back[0, y, x, lane] == 3))
        if not going.any():
            break
        g = np.flatnonzero(going)
        was = s[g]
        s[g] = back[was, y[g], x[g], g]
        y[g] -= was != 2
        i[g] -= was != 1
        x[g] += np.where(was == 1, 1, np.where(was == 2, -1, 0))
        at = n + m - 1 - length[g]
        row_a[g, at] = np.where(was != 1, pa_[g, np.minimum(i[g], n - 1)], gap)
        row_b[g, at] = np.where(was != 2, pb[g, np.minimum(y[g], m - 1)], gap)
        length[g] += 1
    texts = lambda rows: [rows[j, n + m - length[j] :].tobytes().decode("utf-32-le", "surrogatepass") for j in range(count)]
    out = []
    for j, (mid_a, mid_b) in enumerate(zip(texts(row_a), texts(row_b), strict=True)):
        p, q, u, v = int(i[j]), int(y[j]), int(end_i[j]), int(end_y[j])
        out.append((True, "-" * q + a[j][:p] + mid_a + "-" * (m - v) + a[j][u:], b[j][:q] + "-" * p + mid_b + b[j][v:] + "-" * (n - u), int(value[j])))
    return out


def aligned(a: Column | str, b: Column | str, k: int = 10, width: int = 24, scores: Scores = Scores()) -> Column:
    """struct(aligned, a, b, score) of each pair of a row."""

    @F.pandas_udf("aligned boolean, a string, b string, score long")
    def f(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align_all(list(x), list(y), k, width, scores), columns=["aligned", "a", "b", "score"])

    return f(_c(a), _c(b))


_PILE = re.compile(r"\^.|\$|[+-](\d+)|[.,*]|[ACGTNacgtn]")


def parse_pile(dots: str) -> tuple[list[tuple[str, int, str]], int, int, int, int]:
    """Features (kind, length, bases), starts, stops, forward and reverse reads of a samtools column."""
    found, starts, stops, fwd, rev = [], 0, 0, 0, 0
    at = 0
    while at < len(dots):
        m = _PILE.match(dots, at)
        if not m:
            raise ValueError(f"bad pileup at {at}: {dots[at:]}")
        at, c = m.end(), m[0]
        if c[0] == "^":
            starts += 1
        elif c == "$":
            stops += 1
        elif m[1]:
            n = int(m[1])
            found.append(("INS" if c[0] == "+" else "DEL", n, dots[at : at + n]))
            at += n
        elif c == ".":
            fwd += 1
        elif c == ",":
            rev += 1
        elif c != "*":
            found.append(("SNP", 1, c))
            fwd, rev = fwd + c.isupper(), rev + c.islower()
    return found, starts, stops, fwd, rev


def parsed_pile(dots: Column | str) -> Column:
    @F.pandas_udf("feats array<struct<kind:string,len:int,bases:string>>, starts int, stops int, fwd int, rev int")
    def f(x: pd.Series) -> pd.DataFrame:
        rows = [parse_pile(d) for d in x]
        return pd.DataFrame({"feats": [[{"kind": k, "len": n, "bases": b} for k, n, b in r[0]] for r in rows], **{c: [r[i] for r in rows] for i, c in enumerate(("starts", "stops", "fwd", "rev"), 1)}})

    return f(_c(dots))


def scar(s: str, least: int, most: int, seed: int = 8) -> tuple[bool, str | None, str | None]:
    """ok, scar, message: the direct repeat at both ends of s that recombines, one inner base more on one side allowed."""
    if len(s) < 2 * least:
        return False, None, "sequence shorter than two overlaps"
    most = min(most, len(s) // 2)
    head, tail, n = s[:seed], s[-seed:], len(s)
    found = []
    at = s.find(tail)
    while at >= 0:
        if least - seed <= at <= most - seed:
            size = at + seed
            for start in (n - size, n - size + 1, n - size - 1):
                if 0 <= start and s[start : start + seed] == head and _same_but_one(s[:size], s[start:]):
                    found.append(s[:size])
        at = s.find(tail, at + 1)
    if len(set(found)) > 1:  # a run of one base at an end lets the same scar be found with and without the inner base
        return False, None, "several scars"
    return True, (found or [None])[0], None


def _same_but_one(a: str, b: str) -> bool:
    if a == b:
        return True
    long, short = (a, b) if len(a) > len(b) else (b, a)
    if len(long) != len(short) + 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(long, short)) if x != y), len(short))
    return 0 < p < len(short) and long[p + 1 :] == short[p:]


def scars(s: Column | str, least: int = 20, most: int = 1000) -> Column:
    @F.pandas_udf("ok boolean, scar string, message string")
    def f(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scar(v, least, most) for v in x], columns=["ok", "scar", "message"])

    return f(_c(s))


def match_runs(genome: DataFrame, queries: DataFrame, cutoff: int, key: str = "chr", query_id: str = "query_id", seq: str = "seq", query: str = "query") -> DataFrame:
    """Maximal exact matches of at least cutoff bases, on both strands: query_id, key, fwd, q_l, t_l, n.

    Words of cutoff bases meet in an equi-join; neighbouring hits on one diagonal are joined to runs. Spark takes the words
    for as small as the table they are cut from, so that neither side may be broadcast.
    """
    from pyspark.sql import Window

    from ..functions import dna
    from ..plans.kmers import dealt

    words = dealt(queries.select(query_id, query), query_id).select(query_id, F.explode(F.array(F.struct(F.lit(True).alias("fwd"), F.col(query).alias("s")), F.struct(F.lit(False).alias("fwd"), dna.revcomp(query).alias("s")))).alias("x"))
    words = words.select(query_id, F.col("x.fwd").alias("fwd"), F.explode(dna.kmers(F.col("x.s"), cutoff)).alias("k")).select(query_id, "fwd", F.col("k.pos").alias("q"), F.col("k.kmer").alias("w"))
    places = dealt(genome.select(key, seq), key).select(key, F.explode(dna.kmers(seq, cutoff)).alias("k")).select(key, F.col("k.pos").alias("t"), F.col("k.kmer").alias("w"))
    hits = words.join(places.hint("merge"), "w").select(query_id, key, "fwd", "q", (F.col("t") - F.col("q")).alias("d"))
    line = Window.partitionBy(query_id, key, "fwd", "d").orderBy("q")
    runs = hits.withColumn("run", F.col("q") - F.row_number().over(line))
    return runs.groupBy(query_id, key, "fwd", "d", "run").agg(F.min("q").alias("q_l"), (F.max("q") - F.min("q") + cutoff).alias("n")).select(query_id, key, "fwd", "q_l", (F.col("q_l") + F.col("d")).alias("t_l"), "n")


def group_matches(matches: DataFrame, tolerance: int, query_length: str = "query_length", key: str = "chr", query_id: str = "query_id") -> DataFrame:
    """matches with cluster, inferred_l, inferred_r: the clusters of each query, chromosome and strand, numbered from 0.

    Matches are taken by their place in the query. The first of a cluster is its anchor and says where the query's ends would
    lie; a match belongs to every cluster whose anchor predicts its ends to less than the tolerance, and has a row for each. A
    match that belongs to none begins one. Matches are read as a sorted stream that holds the anchors of one query and chromosome.
    """
    own = F.when(F.col("fwd"), F.col("q_l")).otherwise(F.col(query_length) - F.col("q_l") - F.col("n"))
    rows = matches.withColumn("__q", own.cast("long")).withColumn("__d", (F.col("t_l") - F.col("q_l")).cast("long")).withColumn("__length", F.col(query_length).cast("long"))
    rows = rows.repartition(query_id, key, "fwd").sortWithinPartitions(query_id, key, "fwd", "__q", "t_l")
    schema = T.StructType([*matches.schema.fields, *T._parse_datatype_string("cluster long, inferred_l long, inferred_r long").fields])
    carried = matches.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchors = None, []
        for batch in batches:
            place, found = [], []
            columns = (batch.column(c).to_pylist() for c in (query_id, key, "fwd", "__q", "t_l", "n", "__d", "__length"))
            for i, (query, chromosome, fwd, q, t, n, d, length) in enumerate(zip(*columns, strict=True)):
                if group != (query, chromosome, fwd):
                    group, anchors = (query, chromosome, fwd), []
                at = bisect.bisect_right(anchors, (d - tolerance, float("inf")))
                met = []
                while at < len(anchors) and anchors[at][0] < d + tolerance:
                    met.append(anchors[at])
                    at += 1
                if not met:
                    low = t - q if fwd else t + n - 1 - (length - q)
                    met = [(d, len(anchors), low, low + length)]
                    bisect.insort(anchors, met[0])
                place += [i] * len(met)
                found += [x[1:] for x in met]
            out = [batch.column(c).take(pa.array(place, pa.int64())) for c in carried]
            more = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(x, pa.int64()) for x in more)], names=schema.names)

    return rows.mapInArrow(run, schema)


def target_of(query_l: Column, target_l: Column, target_r: Column, fwd: Column, l: Column, r: Column) -> tuple[Column, Column]:
    """Where l to r of a query would lie, by a match that begins at query_l and lies at target_l to target_r."""
    return F.when(fwd, target_l + l - query_l).otherwise(target_r - r + query_l), F.when(fwd, target_l + r - query_l).otherwise(target_r - l + query_l)


def core(a: str, b: str) -> tuple[int, int]:
    """First and last column of two aligned rows in which neither has a gap at an end."""
    return max(len(x) - len(x.lstrip("-")) for x in (a, b)), min(len(x.rstrip("-")) for x in (a, b)) - 1


def evaluated(clusters: DataFrame, genome: DataFrame, queries: DataFrame, tolerance: int, scores: Scores = Scores(), key: str = "chr", query_id: str = "query_id", seq: str = "seq", query: str = "query") -> DataFrame:
    """A row per cluster of group_matches(): query_id, key, fwd, cluster, n_matches, score, length, query_row, target_row.

    The query is aligned with the inferred region and the tolerance around it, on the cluster's strand; length: of the alignment without its loose ends.
    """
    from ..functions import dna

    found = clusters.groupBy(query_id, key, "fwd", "cluster", "inferred_l", "inferred_r").agg(F.count(F.lit(1)).alias("n_matches"))
    start = F.greatest(F.lit(0), F.col("inferred_l") - tolerance).cast("int")
    stop = F.least(F.length(seq) - 1, F.col("inferred_r") + tolerance).cast("int")
    region = dna.substr(seq, start, stop - start + 1)
    region = F.when(F.col("fwd"), region).otherwise(dna.revcomp(region))
    both = found.join(genome.select(key, seq).hint("merge"), key).withColumn("__target", region).drop(seq).join(queries.select(query_id, query).hint("merge"), query_id)

    @F.pandas_udf("score long, length long, query_row string, target_row string")
    def f(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = align_all(list(x), list(y), 20, 24, scores)
        ends = [core(a, b) for _, a, b, _ in rows]
        return pd.DataFrame({"score": [r[3] for r in rows], "length": [r - l + 1 for l, r in ends], "query_row": [r[1] for r in rows], "target_row": [r[2] for r in rows]})

    return both.withColumn("__x", f(query, "__target")).select(query_id, key, "fwd", "cluster", "n_matches", "__x.*")
