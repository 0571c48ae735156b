"""Queries over whole inputs against plain Python: no prefix, no subset of identifiers, no first rows only."""

import math
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from helixspark import queries_dna, queries_misc, queries_plans
from helixspark.functions import dna, tables, thermo
from helixspark.operators import alignment
from helixspark.plans import oligo, text
from helixspark.plans.synth import genome, sequences, table, variants


def test_wrap_other_line_ends(spark):
    s = "ab\r\u2028" * 40
    found = spark.createDataFrame([(s,)], "s string").select(dna.wrap("s")).first()[0]
    assert found == "\n".join(s[i : i + 60] for i in range(0, 160, 60))


def test_fasta_format60(spark):
    found = {r.doc_id: r.wrapped for r in queries_dna.QUERIES["fasta_format60"](spark, SF).collect()}
    texts = {r.doc_id: r.text.replace("\n", " ") for r in table(spark, SF, "documents").collect()}
    assert max(map(len, texts.values())) > 180
    assert found == {k: "\n".join(t[i : i + 60] for i in range(0, len(t), 60)) for k, t in texts.items()}


def melting(s):
    """Degrees of an oligo in mixed salt, one neighbour after the other."""
    p = thermo.Params()
    pairs = [s[i : i + 2] for i in range(len(s) - 1)]
    h = sum(tables.NN_H[x] for x in pairs) + tables.END_H[s[0]] + tables.END_H[s[-1]]
    e = sum(tables.NN_S[x] for x in pairs) + tables.END_S[s[0]] + tables.END_S[s[-1]]
    own = s == s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    kelvin = 1000 * h / (e + (-1.4 if own else 0) + tables.GAS * math.log(p.primer if own else thermo.strand_concentration(p.primer, p.template)))
    t, ln, m = dict(tables.SALT), math.log(p.divalent), math.log(p.monovalent)
    t["a"] *= 0.843 - 0.352 * p.monovalent**0.5 * m
    t["d"] *= 1.279 - 4.03e-3 * m - 8.03e-3 * m * m
    t["g"] *= 0.486 - 0.258 * m + 5.25e-3 * m**3
    gc = sum(c in "GC" for c in s) / len(s)
    return 1 / (1 / kelvin + t["a"] + t["b"] * ln + gc * (t["c"] + t["d"] * ln) + (t["e"] + t["f"] * ln + t["g"] * ln * ln) / (2 * (len(s) - 1))) - 273.15


def windows(seq, target, least=20, spread=5.0):
    """(l, n, oligo): (tm, penalty) of every window that may do."""
    out = {}
    for n in range(least, min(60, len(seq)) + 1):
        for at in range(len(seq) - n + 1):
            s = seq[at : at + n]
            if "CCCC" in s or abs((tm := melting(s)) - target) > spread:
                continue
            end = s[-5:]
            stable = sum(tables.DELTA_G_END[end[i : i + 2]] for i in range(4)) + tables.INIT_G_END[s[-1]] > -9.0
            penalty = abs(at - len(seq) // 2) / 5 + 3 * (s[-1] in "AT") + abs(tm - target) + abs(n - 20) / 3 + 5 * (not stable) + 10 * bool(re.search(r"(.)\1{4}|(..)\2{4}", s))
            out[at, n, s] = tm, penalty
    return out


def seqs(spark):
    return {r.id: r.seq for r in sequences(spark, SF).collect()}


def test_primer_candidates_and_best(spark):
    whole = seqs(spark)
    want = {k: windows(s, 60.0) for k, s in whole.items()}
    found = {}
    for r in queries_misc.QUERIES["primer_candidates"](spark, SF).collect():
        found.setdefault(r.id, {})[r.l, r.n, r.oligo] = r.tm, r.penalty
    assert any(k % 40 for k in found)
    assert max(at + n for v in found.values() for at, n, _ in v) == 64
    assert found.keys() == {k for k, v in want.items() if v}
    for k, v in found.items():
        assert v.keys() == want[k].keys()
        assert all(x == pytest.approx(want[k][w], abs=2e-6) for w, x in v.items())
    best = {k: min((round(p, 9), at, n, s) for (at, n, s), (_, p) in v.items())[3] for k, v in want.items() if v}
    assert {r.id: r.oligo for r in queries_misc.QUERIES["primer_best"](spark, SF).collect()} == best


def test_oligo_compromise(spark):
    whole = seqs(spark)
    found = {r.id: r for r in queries_misc.QUERIES["oligo_compromise"](spark, SF).collect()}
    for k in sorted(whole)[:60]:
        s = whole[k]
        gc = sum(c in "GC" for c in s) / len(s)
        rungs = oligo.ladder("low" if gc < 0.4 else "high" if gc > 0.6 else "medium", thermo.Params())
        own = windows(s, 68.0, 18, 10.0)
        fits = lambda q, n, tm: q.min_length <= n <= q.max_length and abs(tm - 68.0) <= q.tm_max_difference
        ranked = [(i, round(p, 9), at, n, o) for i, q in enumerate(rungs) for (at, n, o), (tm, p) in own.items() if fits(q, n, tm)]
        want = min(ranked, default=None)
        assert (k in found) == (want is not None)
        if want:
            assert (found[k].step, found[k].oligo) == (want[0], want[4])


def test_windows_of_unknown_bases(spark):
    s = "ACGTTGCAAGCTTACCGGATTACAGC"
    df = spark.createDataFrame([(1, s + "x" + s), (2, s), (3, s[:12] + "N" + s[12:])], "id long, seq string")
    found = oligo.candidates(df, 60.0, p=thermo.Params(tm_max_difference=30.0)).withColumn("plain", thermo.melting("oligo")).collect()
    assert {r.id for r in found} == {1, 2, 3} and any(r.l > len(s) for r in found) and not any("x" in r.oligo for r in found)
    assert all(r.tm == pytest.approx(r.plain, abs=1e-9) for r in found)


COMPLEMENT = str.maketrans("ACGT", "TGCA")


def other(s):
    return s[::-1].translate(COMPLEMENT)


def chromosomes(spark):
    return {r.chr: r.seq for r in genome(spark, SF).collect()}


def sites(g, s):
    """(chr, pos) of a word."""
    return [(c, i) for c, t in g.items() for i in range(len(t) - len(s) + 1) if t.startswith(s, i)]


def placed(spark, g):
    """Primer of every part: primer_id: (chr, primer)."""
    low, out = min(g), {}
    for k in seqs(spark):
        c = low + k % len(g)
        w = g[c][k % 900 : k % 900 + 20]
        out[k] = c, other(w) if k % 2 else w
    return out


def test_pcr_primer_hits(spark):
    g = chromosomes(spark)
    want = sorted((k, c, i, fwd) for k, (_, p) in placed(spark, g).items() for fwd, s in ((True, p), (False, other(p))) for c, i in sites(g, s))
    found = sorted((r.primer_id, r.chr, r.pos, r.fwd) for r in queries_plans.QUERIES["pcr_primer_hits"](spark, SF).collect())
    assert {r[0] for r in found} == set(seqs(spark))
    assert found == want


def test_pcr_products_and_unique(spark):
    g = chromosomes(spark)
    want = {}
    for k, (c, _) in placed(spark, g).items():
        a, b = g[c][k % 400 : k % 400 + 18], other(g[c][k % 400 + 120 : k % 400 + 138])
        f, r = (a, b) if k % 2 == 0 else (b, a)
        for fwd in (True, False):
            left, right = (f, other(r)) if fwd else (r, other(f))
            for own, at in sites(g, f if fwd else other(f)):
                ends = [(i + 18 - at, at, i + 17) if fwd else (at + 18 - i, i, at + 17) for x, i in sites(g, right if fwd else left) if x == own and (i >= at + 18 if fwd else at >= i + 18)]
                if ends:
                    n, lo, hi = min(ends)
                    want[k, own, lo, hi, n] = want.get((k, own, lo, hi, n), False) or fwd
    found = {(r.pair_id, r.chr, r.l, r.r, r.n): r.fwd for r in queries_plans.QUERIES["pcr_products"](spark, SF).collect()}
    assert {x[0] for x in found} == set(seqs(spark))
    assert found == want
    by_pair = {}
    for x in sorted(want):
        by_pair.setdefault(x[0], []).append(x)
    unique = {v[0][:4] for v in by_pair.values() if len(v) == 1 or len(v) == 2 and v[0][1] == v[1][1] and abs(v[0][4] - v[1][4]) <= 10}
    assert {tuple(r) for r in queries_plans.QUERIES["pcr_unique"](spark, SF).select("pair_id", "chr", "l", "r").collect()} == unique


def test_vcf_sort(spark):
    want = sorted(tuple(r) for r in variants(spark, SF).select("chr", "pos", "okey", "line").collect())
    found = sorted((r["rank"], r.okey, r.line) for r in queries_misc.QUERIES["vcf_sort"](spark, SF).collect())
    assert len(want) > 500
    assert found == [(i, *r[2:]) for i, r in enumerate(want, 1)]


def test_dna_order(spark):
    want = sorted((k % 40 + 1, s[: k % 40 + 1], k) for k, s in seqs(spark).items())
    found = sorted((r["rank"], r.id) for r in queries_dna.QUERIES["dna_order"](spark, SF).collect())
    assert len(want) > 100
    assert found == [(i, r[2]) for i, r in enumerate(want, 1)]


@pytest.mark.parametrize("n", [0, 1, 3, 1000])
def test_ranked(spark, n):
    rows = [((i * 7919) % n, None if i == 1 else i) for i in range(n)]
    found = text.ranked(spark.createDataFrame(rows, "a long, b long").repartition(3), [F.col("b").desc_nulls_last(), F.col("a")])
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0)))
    assert sorted((r["rank"], r.a, r.b) for r in found.collect()) == [(i, *r) for i, r in enumerate(want, 1)]


def test_sw_align(spark):
    found = {r.id: (r.aligned, r.a, r.b, r.score) for r in queries_misc.QUERIES["sw_align"](spark, SF).collect()}
    assert found == {k: alignment.align(s, s[:30] + "A" + s[30:], 10, 20) for k, s in seqs(spark).items()}


def maximal(s, t, least):
    """(q, t, n) of every maximal exact match, one diagonal after the other."""
    for d in range(-len(s) + 1, len(t)):
        n = 0
        for q in range(max(0, -d), min(len(s), len(t) - d) + 1):
            if q < min(len(s), len(t) - d) and s[q] == t[q + d]:
                n += 1
                continue
            if n >= least:
                yield q - n, q - n + d, n
            n = 0


def test_exact_match_genome_and_group_matches(spark):
    g, want = chromosomes(spark), []
    for k, seq in g.items():
        q = seq[100:140] + "ACGTTGCA" + seq[160:200]
        want += [(k, c, fwd, *m) for fwd, s in ((True, q), (False, other(q))) for c, t in g.items() for m in maximal(s, t, 20)]
    columns = ("query_id", "chr", "fwd", "q_l", "t_l", "n")
    found = sorted(tuple(r) for r in queries_misc.QUERIES["exact_match_genome"](spark, SF).select(*columns).collect())
    assert {r[0] for r in found} == set(g)
    assert found == sorted(want)
    assert sorted(tuple(r) for r in queries_misc.QUERIES["group_matches"](spark, SF).select(*columns, "cluster", "inferred_l", "inferred_r").collect()) == sorted(clustered(want, 88))
    for r in queries_misc.QUERIES["match_evaluate"](spark, SF).collect():
        q = g[r.query_id][100:140] + "ACGTTGCA" + g[r.query_id][160:200]
        assert r.query_row.replace("-", "") == q and r.target_row.replace("-", "") in (g[r.chr] if r.fwd else other(g[r.chr])) and r.score > 0 and 0 < r.length <= len(r.query_row)


def clustered(matches, length, tolerance=15):
    """Matches (query, chr, fwd, q_l, t_l, n) by the law itself, one after the other: with cluster and inferred ends."""
    out, groups = [], {}
    start = lambda m: m[3] if m[2] else length - m[3] - m[5]
    for m in sorted(matches, key=lambda m: (*m[:3], start(m), m[4])):
        anchors = groups.setdefault(m[:3], [])

        def predicted(a):
            l, r = start(m), start(m) + m[5] - 1
            return (a[4] + l - start(a), a[4] + r - start(a)) if m[2] else (a[4] + a[5] - 1 - (r - start(a)), a[4] + a[5] - 1 - (l - start(a)))

        met = [i for i, a in enumerate(anchors) if abs(predicted(a)[0] - m[4]) < tolerance and abs(predicted(a)[1] - (m[4] + m[5] - 1)) < tolerance]
        if not met:
            met = [len(anchors)]
            anchors.append(m)
        for i in met:
            a = anchors[i]
            low = a[4] - start(a) if a[2] else a[4] + a[5] - 1 - (length - start(a))
            out.append((*m, i, low, low + length))
    return out


def test_clusters_are_anchored(spark):
    """Matches whose diagonals drift aren't chained, and one between two anchors belongs to both."""
    rows = [(1, 2, fwd, q, q + d, 20) for fwd in (True, False) for q, d in ((0, 0), (5, 10), (10, 20), (20, 12), (30, 40), (7, 14), (8, 15))]
    df = spark.createDataFrame([(*r, 100) for r in rows], "query_id int, chr int, fwd boolean, q_l long, t_l long, n long, query_length int")
    found = alignment.group_matches(df, 15).drop("query_length")
    assert sorted(tuple(r) for r in found.collect()) == sorted(clustered(rows, 100))
    assert len(clustered(rows, 100)) > len(rows) and alignment.group_matches(df.limit(0), 15).count() == 0
    l, r = alignment.target_of(*(F.lit(x) for x in (10, 100, 119, False, 0, 50)))
    assert tuple(spark.range(1).select(l, r).first()) == (79, 129)


def test_variant_neighbours():
    """Everything in the window is flagged before the variant itself is decided."""
    import pandas as pd

    from helixspark.operators.variant_filter import judge

    rows = pd.DataFrame([(100, "AT", "A", 90, 9, "PASS"), (106, "C", "G", 50, 9, "PASS"), (108, "GT", "G", 10, 9, "PASS")], columns=["pos", "ref", "alt", "qual", "alt_depth", "status"])
    assert judge(rows) == ["PASS", "NEIGHBORING_INDEL", "BETTER_NEIGHBORING_MUTATION"]


PAIRS = [("TGATCTACTGACGTAT-TGATGCATCACTGATCTA", "TGATCTACT-ACGTATCTGATGCATCACTGATCTA"), ("TGATCTACTGACGTATCTGATGC------------", "TGATCTACTGACGTATCTGATGCATCACTGATCTA")]


@pytest.mark.parametrize("a,b", PAIRS)
def test_align_pairs(a, b):
    assert alignment.align(a.replace("-", ""), b.replace("-", ""), 10, 20)[1:3] == (a, b)
    assert alignment.align(a.replace("-", ""), b.replace("-", ""), 10, 20, alignment.Scores(match=1, mismatch=-1, open=-2, extend=-1))[3] < 40


def test_regions_of_a_long_chromosome(spark):
    """Regions over many tiles, short chromosomes, and lengths about a tile's, by plain Python."""
    import random

    from helixspark.plans import intervals

    rng = random.Random(4)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((1, 2, 3, 4, 899, 900, 901, 902, 903, 1801, 5000))}
    seqs[50] = "".join(rng.choice("AC") for _ in range(4001)) + "TAA" + "".join(rng.choice("AC") for _ in range(2000))  # without stops for many tiles
    df = spark.createDataFrame(list(seqs.items()), "chr int, seq string")
    code = {r.codon: r.aa for r in spark.createDataFrame([(a + b + c,) for a in "ACGT" for b in "ACGT" for c in "ACGT"], "codon string").select("codon", dna.codon_to_aa("codon").alias("aa")).collect()}
    want = []
    for k, seq in seqs.items():
        n = len(seq)
        for fwd in (True, False):
            s = seq if fwd else other(seq)
            for frame in range(3):
                at, aa = frame, ""
                for i in range(frame, n - 2, 3):
                    if code[s[i : i + 3]] == "*":
                        want.append((k, fwd, frame, *((at, i + 2) if fwd else (n - 1 - i - 2, n - 1 - at)), aa, True))
                        at, aa = i + 3, ""
                    else:
                        aa += code[s[i : i + 3]]
                if at <= n - 1:
                    want.append((k, fwd, frame, *((at, n - 1) if fwd else (0, n - 1 - at)), aa, False))
    assert sorted(tuple(r) for r in intervals.coding_regions(df).collect()) == sorted(want)


def test_short_primers_and_products(spark):
    """Primers of any length hit, and the nearest reverse site behind counts."""
    import random

    from helixspark.plans import pcr

    rng = random.Random(9)
    g = {k: "".join(rng.choice("ACGT") for _ in range(600)) for k in (1, 2)}
    g[1] = g[1][:100] + "ACGTTGCA" + g[1][100:300] + "ACGTTGCA" + g[1][300:]
    primers = ["ACGTTGCA", "A", "GG", g[2][50:63], g[1][200:241], other(g[2][400:412]), ""]
    gs = spark.createDataFrame(list(g.items()), "chr int, seq string")
    found = pcr.primer_hits(gs, spark.createDataFrame(list(enumerate(primers)), "primer_id int, primer string"))
    want = [(i, c, at, fwd) for i, p in enumerate(primers) if p for c, t in g.items() for fwd, s in ((True, p), (False, other(p))) for at in range(len(t)) if t.startswith(s, at)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert pcr.primer_hits(gs, spark.createDataFrame([], "primer_id int, primer string")).count() == 0
    pairs = [(0, "AC", "GT"), (1, "ACG", "TGC"), (2, g[2][50:65], other(g[2][300:320]))]
    want = set()
    for i, a, b in pairs:
        for c, t in g.items():
            for fwd, s in ((True, t), (False, other(t))):
                for x in (x for x in range(len(s)) if s.startswith(a, x)):
                    ends = [y + len(b) for y in range(x + len(a), len(s)) if s.startswith(other(b), y)]
                    if ends and ends[0] - x <= 300:
                        want.add((i, c, *((x, ends[0] - 1) if fwd else (len(t) - ends[0], len(t) - 1 - x))))
    found = pcr.products(gs, spark.createDataFrame(pairs, "pair_id int, fwd_primer string, rev_primer string"), 300)
    assert {(r.pair_id, r.chr, r.l, r.r) for r in found.collect()} == want
    for r in pcr.product_bases(found, gs).collect():
        assert r.product == (g[r.chr][r.l : r.r + 1] if r.fwd else other(g[r.chr][r.l : r.r + 1]))


def test_long_queries_in_suffixes(spark):
    from helixspark.plans import kmers

    texts = [(1, "abcdefgh" * 40 + "x"), (2, "y" + "abcdefgh" * 20), (3, ""), (4, "aaaa")]
    queries = ["a", "aa", "abcdefgh" * 10, "abcdefgh" * 8, "h" + "abcdefgh" * 9 + "abc", "abcdefgh" * 39 + "abcdefghx", "abcdefgh" * 41, "", "zz"]
    index = kmers.suffixes(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    found = kmers.find_all(index, spark.createDataFrame([(q,) for q in queries], "query string"), "id")
    want = [(q, i, at) for q in queries if q for i, t in texts for at in range(len(t)) if t.startswith(q, at)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_queries_with_quoting_ends(spark):
    s, q = "a\\Eb\\E\\Ec", "\\E"
    assert spark.createDataFrame([(s, q)], "s string, q string").select(dna.indices_of("s", "q"), dna.count_of("s", "q")).first()[:] == ([1, 4, 6], 3)


def grown(seq, target, p=thermo.Params()):
    """(oligo, tm) from the template's start, step by step."""
    stable = lambda s: sum(tables.DELTA_G_END[s[-5:][i : i + 2]] for i in range(4)) + tables.INIT_G_END[s[-1]] > -9.0
    last, i = 0.0, 0
    while True:
        this = 0.0 if i < p.min_length - 1 else melting(seq[: i + 1])
        if this < target and i < len(seq) - 1:
            last, i = this, i + 1
            continue
        break
    if i >= p.max_length:
        return seq[: p.max_length], melting(seq[: p.max_length])
    t, was = (i, this) if i < p.min_length or abs(this - target) < abs(last - target) else (i - 1, last)
    ends = []
    for step in (1, -1):
        at = t
        while not (seq[at] in "GC" and stable(seq[: at + 1])):
            if not (at < len(seq) - 1 and at + 1 < p.max_length if step == 1 else at > 1 and at + 1 > p.min_length):
                at = t
                break
            at += step
        ends.append((at, melting(seq[: at + 1])))
    ahead, behind = ends
    at, tm = ahead if abs(ahead[1] - was) < abs(behind[1] - was) else behind
    return (seq[: at + 1], tm) if abs(tm - was) <= p.at_penalty else (seq[: t + 1], melting(seq[: t + 1]))


def test_oligo_tasks(spark):
    """Anchors, strands, offsets and penalties by plain Python; short and long templates too."""
    import random

    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (22, 25, 30, 45, 61, 80)] + ["AT" * 40, "GC" * 12 + "A" * 30, "ACGTTGCAAG"]
    tasks = [(len(seqs) * i + j, s, a, t, 100, 60.0, [float((7 * x + j) % 5) for x in range(len(s))] if j % 2 else None) for i, (a, t) in enumerate((x, y) for x in ("LEFT", "CENTERLEFT", "RIGHT", "CENTERRIGHT") for y in ("TOP", "BOTTOM")) for j, s in enumerate(seqs)]
    df = spark.createDataFrame(tasks, "id int, seq string, align string, strand string, offset int, target double, penalties array<double>")
    found = {r.id: r for r in oligo.designed(df).collect()}
    assert len(found) == len(tasks)
    for k, seq, align, strand, offset, target, own in tasks:
        s, own, align = (seq, own, align) if strand == "TOP" else (other(seq), own and own[::-1], {"LEFT": "RIGHT", "RIGHT": "LEFT", "CENTERRIGHT": "CENTERLEFT"}.get(align))
        r = found[k]
        if align == "LEFT":
            want = grown(s, target)
            assert (r.oligo, r.tm, r.offset) == (want[0], pytest.approx(want[1], abs=1e-6), offset)
        elif align == "CENTERLEFT":
            ranked = sorted((round(p + (sum(own[at : at + n]) / n if own else 0), 9), at, n, o) for (at, n, o), (_, p) in windows(s, target).items())
            assert (r.oligo, r.offset) == ((ranked[0][3], offset + ranked[0][1] * (1 if strand == "TOP" else -1)) if ranked else (None, None))
            assert (r.note == "") == bool(ranked)
        else:
            assert r.oligo is None and "anchor" in r.note


def test_results_of_options_and_exceptions(spark):
    from helixspark.functions import result

    df = spark.createDataFrame([(1, "4", None), (2, None, "gone"), (3, "x", None)], "id int, a string, b string")
    number = lambda c: result.checked(c.try_cast("int"), [(c.try_cast("int").isNotNull(), "no number")])
    got = df.select("id", result.of_choice("a", "b").alias("c"), result.optional("a", number).alias("o"), result.caught(lambda x: 8 // int(x), "a", "long", lambda e: type(e).__name__).alias("k")).orderBy("id").collect()
    assert [tuple(r.c) for r in got] == [(True, "4", []), (False, None, ["gone"]), (True, "x", [])]
    assert [tuple(r.o) for r in got] == [(True, 4, []), (True, None, []), (False, None, ["no number"])]
    assert [tuple(r.k) for r in got] == [(True, 2, []), (False, None, ["TypeError"]), (False, None, ["ValueError"])]
    try:
        try:
            int("x")
        except ValueError as e:
            raise KeyError("outer") from e
    except KeyError as e:
        text = result.exception_text(e, "while reading")
    assert text.startswith("while reading\n\n'outer'\nType: builtins.KeyError") and "2) invalid literal" in text


def test_renamed_chromosomes(spark):
    from helixspark.plans import intervals

    names = list(tables.chromosomes().items())[:3] + [("7", 7)]
    df = spark.createDataFrame([(n, "ACGT") for n, _ in names], "chr string, seq string")
    assert sorted(r.chr for r in intervals.renamed(df).collect()) == sorted(k for _, k in names)
