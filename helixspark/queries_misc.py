"""Registered queries over variants, thermodynamics, statistics, formats and order-dependent operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .functions import stats, tables, thermo, vcf
from .operators import alignment, variant_filter
from .plans import oligo
from .plans.synth import features, genome, sequences, sql_dna32, table, variants, with_
from .sources import formats

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


_V = with_("variants")
_DP4 = [f"CAST(regexp_extract(info, 'DP4=(\\d+),(\\d+),(\\d+),(\\d+)', {i}) AS INT)" for i in range(1, 5)]


@register("vcf_info_extract", rf"{_V} SELECT okey, line, regexp_extract(info, 'DP=([0-9]+)', 1) AS depth, {' + '.join(_DP4)} AS call_depth, CAST(regexp_extract(info, 'MQ=(\d+)', 1) AS INT) AS mq, TRY_CAST(nullif(regexp_extract(info, 'PV4=[0-9.]+,([0-9.e-]+)', 1), '') AS DOUBLE) AS base_q FROM variants")
def _(spark, sf):
    return variants(spark, sf).select("okey", "line", vcf.depth("info").alias("depth"), vcf.call_depth(vcf.dp4("info")).alias("call_depth"), vcf.map_quality("info").alias("mq"), vcf.pv4("info")["base_q"].alias("base_q"))


@register("vcf_mutness", f"{_V}, d AS (SELECT okey, line, {' + '.join(_DP4)} AS n, {_DP4[2]} + {_DP4[3]} AS a FROM variants) SELECT okey, line, round(CASE WHEN n = 0 THEN -1.0 ELSE a / CAST(n AS DOUBLE) END, 6) AS m FROM d")
def _(spark, sf):
    return variants(spark, sf).select("okey", "line", F.round(F.nanvl(vcf.mutness(vcf.dp4("info")), F.lit(-1.0)), 6).alias("m"))


@register("vcf_mutation_type", f"{_V} SELECT CASE WHEN length(ref) <> length(alt) THEN 'INDEL' WHEN length(ref) = 1 THEN 'SNP' ELSE 'MNP' END AS kind, count(*) AS n FROM variants GROUP BY ALL")
def _(spark, sf):
    return variants(spark, sf).groupBy(vcf.kind("ref", "alt").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("vcf_mnp_split", f"{_V} SELECT okey, line, pos + i AS pos, substr(ref, i + 1, 1) AS ref, substr(alt, i + 1, 1) AS alt FROM (SELECT *, unnest(range(length(ref))) AS i FROM variants WHERE length(ref) = length(alt) AND length(ref) > 1)")
def _(spark, sf):
    mnp = variants(spark, sf).filter(vcf.kind("ref", "alt") == "MNP")
    return mnp.select("okey", "line", F.explode(vcf.split_mnp("pos", "ref", "alt")).alias("x")).select("okey", "line", "x.*")


@register("vcf_apply", f"{with_('seqs')} SELECT id, substr(seq, 1, CAST(id % 50 AS BIGINT)) || 'TTT' || substr(seq, CAST(id % 50 + 3 AS BIGINT)) AS seq FROM seqs")
def _(spark, sf):
    at = F.col("id") % 50
    return sequences(spark, sf).select("id", vcf.applied("seq", 100, at + 100, F.substring("seq", (at + 1).cast("int"), F.lit(2)), F.lit("TTT")).alias("seq"))


_PV = r"CAST(regexp_extract(info, 'PV4=([0-9.e-]+),([0-9.e-]+),([0-9.e-]+),([0-9.e-]+)', {}) AS DOUBLE)"
_HARD = rf"""CASE WHEN d < 2 THEN 'DEPTH_TOO_LOW' WHEN a < 2 THEN 'ALT_DEPTH_TOO_LOW' WHEN mq < 10 THEN 'MAPPING_QUAL_TOO_LOW'
    WHEN contains(info, 'PV4=') AND (TRY_{_PV.format(1)} < 1e-4 OR TRY_{_PV.format(2)} < 1e-100 OR TRY_{_PV.format(3)} < 0 OR TRY_{_PV.format(4)} < 1e-4) THEN 'FAILED_PV' ELSE 'PASS' END"""


@register("vcf_hard_filter", f"{_V}, x AS (SELECT *, {' + '.join(_DP4)} AS d, {_DP4[2]} + {_DP4[3]} AS a, CAST(regexp_extract(info, 'MQ=(\\d+)', 1) AS INT) AS mq FROM variants) SELECT okey, line, {_HARD} AS status FROM x")
def _(spark, sf):
    return variants(spark, sf).select("okey", "line", vcf.hard_filter(vcf.dp4("info"), vcf.map_quality("info"), vcf.pv4("info")).alias("status"))


def _sql_labels(status: str) -> str:
    return f"CASE {status} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.VCF_STATUS.items()) + " END"


_PACK = "{{'okey': {0}.okey, 'line': {0}.line, 'pos': {0}.pos, 'last': {0}.last, 'indel': {0}.indel, 'score': {0}.score, 'status': {1}}}"
_STAGED = "s.status = 'PASS' AND v.hard = 'PASS'"
#: One variant of each chromosome at a time; held has those within the window, gone those that it has left.
_NEIGHBOURS = f"""{_V}, x AS (SELECT *, {' + '.join(_DP4)} AS d, {_DP4[2]} + {_DP4[3]} AS a, CAST(regexp_extract(info, 'MQ=(\\d+)', 1) AS INT) AS mq FROM variants),
    v AS (SELECT chr, pos, okey, line, pos + length(ref) - 1 AS last, length(ref) <> length(alt) AS indel, CAST(trunc(qual) AS BIGINT) * 1000 + a AS score, {_HARD} AS hard,
        row_number() OVER (PARTITION BY chr ORDER BY pos, ref, alt, qual, info, okey, line) AS k FROM x WHERE ref <> 'N' AND alt <> '.'),
    RECURSIVE_r AS (SELECT chr, 1::BIGINT AS k, [{_PACK.format('v', 'v.hard')}] AS held, list_filter([{_PACK.format('v', 'v.hard')}], lambda s: false) AS gone FROM v WHERE k = 1
        UNION ALL SELECT v.chr, v.k, list_append(list_transform(list_filter(r.held, lambda s: s.last + 10 >= v.pos), lambda s: {_PACK.format('s', f"""CASE
            WHEN {_STAGED} AND s.indel = v.indel AND s.score <= v.score AND s.last + CASE WHEN v.indel THEN 10 ELSE 0 END >= v.pos THEN 'BETTER_NEIGHBORING_MUTATION'
            WHEN {_STAGED} AND v.indel AND NOT s.indel AND s.last + 3 >= v.pos THEN 'NEIGHBORING_INDEL' ELSE s.status END""")}),
          {_PACK.format('v', f"""CASE WHEN {_STAGED.replace("s.status = 'PASS' AND ", '')} AND len(list_filter(r.held, lambda s: s.status = 'PASS' AND (s.indel = v.indel AND s.score > v.score AND s.last + CASE WHEN v.indel THEN 10 ELSE 0 END >= v.pos
            OR s.indel AND NOT v.indel AND s.last + 3 >= v.pos))) > 0 THEN CASE WHEN v.indel THEN 'BETTER_NEIGHBORING_MUTATION' ELSE 'NEIGHBORING_INDEL' END ELSE v.hard END""")}),
          list_filter(r.held, lambda s: s.last + 10 < v.pos) FROM RECURSIVE_r AS r JOIN v ON v.chr = r.chr AND v.k = r.k + 1),
    ends AS (SELECT chr, max(k) AS k FROM v GROUP BY chr),
    f AS (SELECT chr, unnest(gone) AS s FROM RECURSIVE_r UNION ALL SELECT r.chr, unnest(held) FROM RECURSIVE_r AS r JOIN ends ON r.chr = ends.chr AND r.k = ends.k)
    SELECT chr, s.pos AS pos, s.okey AS okey, s.line AS line, s.status AS status, {_sql_labels('s.status')} AS label FROM f""".replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_r", "r0")


@register("vcf_filter_full", _NEIGHBOURS)
def _(spark, sf):
    return variant_filter.filter_variants(variants(spark, sf)).select("chr", "pos", "okey", "line", "status", vcf.label("status").alias("label"))


@register("vcf_sort", f"{_V} SELECT okey, line, row_number() OVER (ORDER BY chr, pos, okey, line) AS rank FROM variants")
def _(spark, sf):
    from .plans.text import ranked

    return ranked(variants(spark, sf).select("chr", "pos", "okey", "line"), [F.col(c) for c in ("chr", "pos", "okey", "line")]).select("okey", "line", "rank")


@register("variants_in_range", f"{_V} SELECT okey, line FROM variants WHERE chr = 3 AND pos BETWEEN 1000 AND 30000")
def _(spark, sf):
    return variants(spark, sf).filter("chr = 3 AND pos BETWEEN 1000 AND 30000").select("okey", "line")


@register("depth_avg_by_chrom", "SELECT l_suppkey % 16 AS chr, round(avg(l_quantity), 6) AS depth, max(l_orderkey) AS len FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("chr")).agg(F.round(F.avg("l_quantity"), 6).alias("depth"), F.max("l_orderkey").alias("len"))


@register("depth_range", "SELECT l_orderkey % 1000 AS pos, CAST(max(l_quantity) AS INT) AS depth FROM lineitem WHERE l_suppkey % 16 = 2 AND l_orderkey % 1000 BETWEEN 100 AND 200 GROUP BY ALL")
def _(spark, sf):
    d = table(spark, sf, "lineitem").filter("l_suppkey % 16 = 2").select((F.col("l_orderkey") % 1000).alias("pos"), "l_quantity")
    return d.filter(F.col("pos").between(100, 200)).groupBy("pos").agg(F.max("l_quantity").cast("int").alias("depth"))


@register("depth_runs", "WITH p AS (SELECT DISTINCT l_suppkey % 16 AS chr, l_orderkey % 3000 AS pos FROM lineitem), r AS (SELECT *, pos - row_number() OVER (PARTITION BY chr ORDER BY pos) AS run FROM p) SELECT chr, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM r GROUP BY chr, run")
def _(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).alias("chr"), (F.col("l_orderkey") % 3000).alias("pos")).distinct()
    return formats.depth_runs(p)


@register("goo_decode", "SELECT l_orderkey AS k, l_linenumber AS n, w & 255 AS chr, substr('ACGT', ((w >> 8) & 3) + 1, 1) AS a, substr('ACGT', ((w >> 12) & 3) + 1, 1) AS b, ((w >> 16) & 255) + 256 * (l_linenumber & 255) AS fwd, (w >> 24) & 255 AS rev FROM (SELECT *, (l_partkey * 7919 + l_orderkey * 104729) & 4294967295 AS w FROM lineitem)")
def _(spark, sf):
    word = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729).bitwiseAND(4294967295)
    x = vcf.decode_snp(word, F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x["chr"].alias("chr"), x["from"].alias("a"), x["to"].alias("b"), x["fwd"].alias("fwd"), x["rev"].alias("rev"))


def _dots():
    return F.concat(F.lit("^]"), F.translate(F.substring("seq", 1, 20), "ACGT", ".,.,"), F.lit("Aa$"), F.when(F.col("id") % 2 == 0, "+2ac").otherwise("*"))


@register("pileup_parse", f"{with_('seqs')} SELECT id, 1 AS starts, 1 AS stops, CAST(length(regexp_replace(substr(seq, 1, 20), '[CT]', '', 'g')) + 1 AS INT) AS fwd, CAST(length(regexp_replace(substr(seq, 1, 20), '[AG]', '', 'g')) + 1 AS INT) AS rev, CASE WHEN id % 2 = 0 THEN 'SNP1A,SNP1a,INS2ac' ELSE 'SNP1A,SNP1a' END AS feats FROM seqs")
def _(spark, sf):
    p = sequences(spark, sf).select("id", alignment.parsed_pile(_dots()).alias("p"))
    feats = F.array_join(F.transform("p.feats", lambda f: F.concat(f["kind"], f["len"].cast("string"), f["bases"])), ",")
    return p.select("id", "p.starts", "p.stops", "p.fwd", "p.rev", feats.alias("feats"))


# -- thermodynamics


def _sql_sum(s: str, values: dict) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items() if "N" not in k)
    return f"list_sum(list_transform(range(length({s}) - 1), lambda i: CAST(CASE substr({s}, i + 1, 2) {cases} END AS DOUBLE)))"


def _sql_ends(s: str, values: dict) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items() if k != "N")
    return f"(CAST(CASE substr({s}, 1, 1) {cases} END AS DOUBLE) + CAST(CASE right({s}, 1) {cases} END AS DOUBLE))"


_P = thermo.Params()


def _sql_tm(s: str) -> str:
    ct = thermo.strand_concentration(_P.primer, _P.template)
    own = f"{s} = reverse(translate({s}, 'ACGT', 'TGCA'))"
    return f"1000 * ({_sql_ends(s, tables.END_H)} + {_sql_sum(s, tables.NN_H)}) / ({_sql_ends(s, tables.END_S)} + {_sql_sum(s, tables.NN_S)} + CASE WHEN {own} THEN -1.4 + 1.98722 * ln({_P.primer!r}) ELSE 1.98722 * ln({ct!r}) END)"


def _sql_melting(s: str) -> str:
    t, ln, m = dict(tables.SALT), math.log(_P.divalent), math.log(_P.monovalent)
    a, d, g = t["a"] * (0.843 - 0.352 * _P.monovalent**0.5 * m), t["d"] * (1.279 - 4.03e-3 * m - 8.03e-3 * m * m), t["g"] * (0.486 - 0.258 * m + 5.25e-3 * m**3)
    gc = f"length(regexp_replace({s}, '[AT]', '', 'g')) / CAST(length({s}) AS DOUBLE)"
    return f"1 / (1 / ({_sql_tm(s)}) + {a + t['b'] * ln!r}::DOUBLE + {gc} * {t['c'] + d * ln!r}::DOUBLE + {t['e'] + t['f'] * ln + g * ln * ln!r}::DOUBLE / (2.0 * (length({s}) - 1))) - 273.15"


_OLIGO = f"{with_('seqs')}, o AS (SELECT id, substr(seq, 1, CAST(18 + id % 12 AS BIGINT)) AS s FROM seqs)"


def _oligos(spark, sf):
    return sequences(spark, sf).select("id", F.substring("seq", F.lit(1), (18 + F.col("id") % 12).cast("int")).alias("s"))


@register("nn_tm", f"{_OLIGO} SELECT id, round({_sql_tm('s')}, 6) AS kelvin FROM o")
def _(spark, sf):
    return _oligos(spark, sf).select("id", F.round(thermo.tm_1m("s"), 6).alias("kelvin"))


@register("tm_salt_regimes", f"{_OLIGO} SELECT id, round({_sql_melting('s')}, 6) AS tm FROM o")
def _(spark, sf):
    return _oligos(spark, sf).select("id", F.round(thermo.melting("s"), 6).alias("tm"))


@register("delta_g", f"{_OLIGO} SELECT id, round({_sql_sum('s', tables.DELTA_G)}, 6) AS dg FROM o")
def _(spark, sf):
    return _oligos(spark, sf).select("id", F.round(thermo.pair_sum("s", tables.DELTA_G), 6).alias("dg"))


@register("three_prime_stable", f"{_OLIGO} SELECT id, {_sql_sum('right(s, 5)', tables.DELTA_G_END)} + CASE WHEN right(s, 1) IN ('G', 'C') THEN -1.96 ELSE -2.01 END > -9.0 AS stable FROM o")
def _(spark, sf):
    return _oligos(spark, sf).select("id", thermo.three_prime_stable("s").alias("stable"))


@register("tm_rule_of_thumb", f"{with_('seqs')}, o AS (SELECT id, substr(seq, 1, CAST(8 + id % 12 AS BIGINT)) AS s FROM seqs), g AS (SELECT id, length(s) AS n, length(regexp_replace(s, '[AT]', '', 'g')) AS gc FROM o) SELECT id, CAST(CASE WHEN n < 14 THEN 4 * gc + 2 * (n - gc) ELSE trunc(CAST(64.9 + 41.0 * (gc - 16.4) / n AS DOUBLE)) END AS INT) AS tm FROM g")
def _(spark, sf):
    s = F.substring("seq", F.lit(1), (8 + F.col("id") % 12).cast("int"))
    gc = F.regexp_count(s, F.lit("[GC]"))
    return sequences(spark, sf).select("id", thermo.rule_of_thumb(gc, F.length(s)).cast("int").alias("tm"))


def _sql_windows(sql: str) -> str:
    """sql over a window s of seq, sums of its neighbours taken from lists of the whole sequence."""
    return sql.replace(_sql_sum("s", tables.NN_H), "list_sum(hs[l + 1:l + n - 1])").replace(_sql_sum("s", tables.NN_S), "list_sum(es[l + 1:l + n - 1])")


def _sql_pairs(values: dict) -> str:
    return _sql_sum("seq", values).removeprefix("list_sum(")[:-1]


_STABLE = f"{_sql_sum('right(s, 5)', tables.DELTA_G_END)} + CASE WHEN right(s, 1) IN ('G', 'C') THEN -1.96 ELSE -2.01 END > -9.0"


def _sql_candidates(target: float, least: int, spread: float) -> str:
    """f: the windows of all sequences, of 64 bases each, that may do."""
    return f"""{with_('seqs')}, p AS (SELECT id, seq, {_sql_pairs(tables.NN_H)} AS hs, {_sql_pairs(tables.NN_S)} AS es FROM seqs),
    w AS (SELECT id, l, n, hs, es, substr(seq, l + 1, n) AS s FROM p, (SELECT unnest(range({65 - least})) AS l) a, (SELECT unnest(range({least}, 61)) AS n) b WHERE l + n <= length(seq)),
    c AS (SELECT id, l, n, s, {_sql_windows(_sql_melting('s'))} AS tm FROM w WHERE NOT contains(s, 'CCCC')),
    f AS (SELECT id, l, n, s AS oligo, tm, abs(l - 32) / 5.0 + CASE WHEN right(s, 1) IN ('A', 'T') THEN 3.0 ELSE 0 END + abs(tm - {target}) + abs(n - 20) / 3.0 + CASE WHEN {_STABLE} THEN 0 ELSE 5.0 END
        + CASE WHEN {' OR '.join([f"contains(s, repeat('{a}', 5))" for a in 'ACGT'] + [f"contains(s, repeat('{a}{b}', 5))" for a in 'ACGT' for b in 'ACGT'])} THEN 10.0 ELSE 0 END AS penalty FROM c WHERE abs(tm - {target}) <= {spread})"""


_CAND = _sql_candidates(60, 20, 5)


@register("primer_candidates", f"{_CAND} SELECT id, l, n, oligo, round(tm, 6) AS tm, round(CAST(penalty AS DOUBLE), 6) AS penalty FROM f")
def _(spark, sf):
    c = oligo.candidates(sequences(spark, sf), 60.0)
    return c.select("id", F.col("l").cast("long").alias("l"), F.col("n").cast("long").alias("n"), "oligo", F.round("tm", 6).alias("tm"), F.round("penalty", 6).alias("penalty"))


@register("primer_best", f"{_CAND} SELECT id, oligo FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(CAST(penalty AS DOUBLE), 9), l, n) = 1")
def _(spark, sf):
    return oligo.best_candidates(sequences(spark, sf), 60.0).select("id", "oligo")


_LEFT = f"""{with_('seqs')}, p AS (SELECT id, seq, unnest(range(20, 61)) AS n FROM seqs), e AS (SELECT id, n, substr(seq, 1, n) AS s FROM p),
    v AS (SELECT id, n, s, {_sql_melting('s')} AS tm, right(s, 1) IN ('G', 'C') AND {_STABLE} AS ok FROM e),
    h AS (SELECT id, min(n) FILTER (WHERE tm >= 60) AS stop FROM v GROUP BY id),
    t AS (SELECT h.id, stop, x.tm AS this, coalesce(y.tm, 0) AS last, stop <= 20 OR abs(x.tm - 60) < abs(coalesce(y.tm, 0) - 60) AS own FROM h LEFT JOIN v AS x ON x.id = h.id AND x.n = stop LEFT JOIN v AS y ON y.id = h.id AND y.n = stop - 1),
    u AS (SELECT id, stop, CASE WHEN own THEN stop ELSE stop - 1 END AS t, CASE WHEN own THEN this ELSE last END AS was FROM t),
    m AS (SELECT u.id, any_value(u.stop) AS stop, any_value(t) AS t, any_value(was) AS was, coalesce(min(n) FILTER (WHERE ok AND n >= t), any_value(t)) AS ahead, coalesce(max(n) FILTER (WHERE ok AND n <= t), any_value(t)) AS behind FROM u JOIN v ON u.id = v.id GROUP BY u.id),
    k AS (SELECT m.*, CASE WHEN abs(a.tm - was) < abs(b.tm - was) THEN ahead ELSE behind END AS moved, CASE WHEN abs(a.tm - was) < abs(b.tm - was) THEN a.tm ELSE b.tm END AS to_tm
        FROM m LEFT JOIN v AS a ON a.id = m.id AND a.n = ahead LEFT JOIN v AS b ON b.id = m.id AND b.n = behind)
    SELECT k.id, v.s AS oligo, round(v.tm, 6) AS tm FROM k JOIN v ON v.id = k.id AND v.n = CASE WHEN stop IS NULL THEN 60 WHEN abs(to_tm - was) <= 3 THEN moved ELSE t END"""


@register("oligo_left", _LEFT)
def _(spark, sf):
    return oligo.grown(sequences(spark, sf), 60.0).select("id", "oligo", F.round("tm", 6).alias("tm"))


def _sql_step() -> str:
    """The first step of the ladder under which a window would do."""
    steps = lambda gc: "CASE " + " ".join(f"WHEN n BETWEEN {q.min_length} AND {q.max_length} AND abs(tm - 68) <= {q.tm_max_difference} THEN {i}" for i, q in enumerate(oligo.ladder(gc, _P))) + " END"
    return f"CASE WHEN gc < 0.4 THEN {steps('low')} WHEN gc > 0.6 THEN {steps('high')} ELSE {steps('medium')} END"


@register("oligo_compromise", f"""{_sql_candidates(68, 18, 10)}, g AS (SELECT id, length(regexp_replace(seq, '[AT]', '', 'g')) / CAST(length(seq) AS DOUBLE) AS gc FROM seqs), s AS (SELECT f.*, {_sql_step()} AS step FROM f JOIN g USING (id))
    SELECT id, step, oligo, round(tm, 6) AS tm FROM s WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY step, round(CAST(penalty AS DOUBLE), 9), l, n) = 1""")
def _(spark, sf):
    return oligo.compromised(sequences(spark, sf), 68.0).select("id", "step", "oligo", F.round("tm", 6).alias("tm"))


@register("oligo_tasks")
def _(spark, sf):
    anchors, strands = F.array(*(F.lit(x) for x in ("LEFT", "CENTERLEFT", "RIGHT", "CENTERRIGHT"))), F.array(F.lit("TOP"), F.lit("BOTTOM"))
    own = F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.pmod(i + F.col("id"), F.lit(7)).cast("double"))
    tasks = sequences(spark, sf).select("id", "seq", F.get(anchors, F.pmod("id", F.lit(4)).cast("int")).alias("align"), F.get(strands, F.pmod(F.floor(F.col("id") / 4), F.lit(2)).cast("int")).alias("strand"), (F.col("id") * 10).alias("offset"), (58 + F.col("id") % 5).alias("target"), F.when(F.col("id") % 3 == 0, own).alias("penalties"))
    return oligo.designed(tasks, compromise=True).select("id", "oligo", F.round("tm", 6).alias("tm"), "offset", "note")


@register("unit_conversions", "SELECT p_partkey, round(p_retailprice - 273.15, 6) AS c, round(p_retailprice + 273.15, 6) AS k, round(p_retailprice / 1e3, 9) AS m_mm, round(p_retailprice / 1e6, 9) AS m_um, round(p_retailprice / 1e9, 12) AS m_nm FROM part")
def _(spark, sf):
    x = "p_retailprice"
    return table(spark, sf, "part").select("p_partkey", F.round(thermo.celsius(x), 6).alias("c"), F.round(thermo.kelvin(x), 6).alias("k"), F.round(thermo.molar(x, "mM"), 9).alias("m_mm"), F.round(thermo.molar(x, "uM"), 9).alias("m_um"), F.round(thermo.molar(x, "nM"), 12).alias("m_nm"))


@register("interval_order", f"{with_('features')}, x AS (SELECT id, chr * 10000000 + l AS al, chr * 10000000 + r AS ar, (chr + id % 3 - 1) * 10000000 + l + id % 1000 - 500 AS bl, (chr + id % 3 - 1) * 10000000 + r + id % 1000 - 500 AS br FROM features) SELECT id, CAST(CASE WHEN ar < bl THEN -1 WHEN al > br THEN 1 ELSE 0 END AS INT) AS side FROM x")
def _(spark, sf):
    from .plans import intervals

    shift = F.col("id") % 1000 - 500
    other = (F.col("chr") + F.col("id") % 3 - 1, F.col("l") + shift, F.col("r") + shift)
    return features(spark, sf).select("id", intervals.compared(("chr", "l", "r"), other).alias("side"))


@register("result_options", "SELECT c_custkey, c_acctbal >= 0 AS ok, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value, CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1 END AS n FROM customer")
def _(spark, sf):
    from .functions import result

    r = result.of_optional(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "no balance")
    return table(spark, sf, "customer").select("c_custkey", r.alias("r")).select("c_custkey", F.col("r.ok").alias("ok"), F.col("r.value").alias("value"), F.size("r.messages").alias("n"))


# -- statistics


@register("stats_descriptive", "SELECT event_type, round(avg(value), 6) AS mean, round(avg(value * value), 4) AS ssq, round(var_pop(value), 4) AS var, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def _(spark, sf):
    mean, ssq, var, sd, _ = stats.describe("value")
    return table(spark, sf, "events").groupBy("event_type").agg(mean, ssq, var, sd).select("event_type", F.round("mean", 6).alias("mean"), F.round("ssq", 4).alias("ssq"), F.round("var", 4).alias("var"), F.round("sd", 6).alias("sd"))


@register("stats_median", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@register("ttest_stat", "WITH s AS (SELECT count(*) FILTER (user_id % 2 = 0) AS n1, count(*) FILTER (user_id % 2 = 1) AS n2, avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1) AS d, var_pop(value) FILTER (user_id % 2 = 0) AS v1, var_pop(value) FILTER (user_id % 2 = 1) AS v2 FROM events) SELECT round(d / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS dof FROM s")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 2).alias("g"), "value")
    return stats.t_test(e, "g", "value", 0, 1).select(F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"))


def _pvalues(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (((F.col("o_orderkey") * 7919) % 10007 + 1) / 10008.0 * F.when(F.col("o_orderkey") % 50 == 0, 1e-6).otherwise(1.0)).alias("p"))


_PVAL = "WITH pv AS (SELECT o_orderkey, CAST((o_orderkey * 7919) % 10007 + 1 AS DOUBLE) / 10008.0::DOUBLE * CASE WHEN o_orderkey % 50 = 0 THEN 1e-6::DOUBLE ELSE 1.0::DOUBLE END AS p FROM orders), m AS (SELECT count(*) AS m, least(1.0, count(*) FILTER (p > 0.5) / (count(*) * 0.5::DOUBLE)) AS share FROM pv), r AS (SELECT o_orderkey, p, m, share, count(*) OVER (ORDER BY p) AS upto, count(*) OVER (PARTITION BY p) AS ties FROM pv, m)"


@register("qvalues", f"{_PVAL} SELECT o_orderkey, round(least(1.0, min(p * share * m / upto) OVER (ORDER BY p DESC)), 9) AS q FROM r")
def _(spark, sf):
    return stats.q_values(_pvalues(spark, sf)).select("o_orderkey", F.round("q", 9).alias("q"))


@register("holm", f"{_PVAL}, k AS (SELECT *, min(CASE WHEN p <= 0.05::DOUBLE / (m - (upto - ties)) THEN 1 ELSE 0 END) OVER (ORDER BY p) AS ok FROM r) SELECT o_orderkey FROM k WHERE ok = 1")
def _(spark, sf):
    return stats.holm(_pvalues(spark, sf)).select("o_orderkey")


@register("ncr_table", "SELECT n, k, CAST(round(factorial(CAST(n AS INT)) / (factorial(CAST(k AS INT)) * factorial(CAST(n - k AS INT)))) AS BIGINT) AS c FROM (SELECT unnest(range(1, 21)) AS n) a, (SELECT unnest(range(0, 21)) AS k) b WHERE k <= n")
def _(spark, sf):
    grid = spark.range(1, 21).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id").cast("int"))).alias("k"))
    return grid.select("n", F.col("k").cast("long").alias("k"), F.round(stats.ncr("n", "k")).cast("long").alias("c"))


def _sql_c(n, k):
    return f"(gamma({n} + 1.0) / (gamma({k} + 1.0) * gamma({n} - {k} + 1.0)))"


@register("hypergeom", f"SELECT p_partkey, round({_sql_c('20', 'k')} * {_sql_c('30', '(10 - k)')} / {_sql_c('50', '10')}, 9) AS prob FROM (SELECT p_partkey, CAST(p_partkey % 11 AS DOUBLE) AS k FROM part)")
def _(spark, sf):
    k = (F.col("p_partkey") % 11).cast("int")
    return table(spark, sf, "part").select("p_partkey", F.round(stats.hypergeo(F.lit(50), F.lit(10), k, F.lit(20)), 9).alias("prob"))


@register("binomial_cdf", f"SELECT p_partkey, round(CAST((SELECT sum({_sql_c('12', 'CAST(i AS DOUBLE)')} * 0.3::DOUBLE ** i * 0.7::DOUBLE ** (12 - i)) FROM (SELECT unnest(range(13)) AS i) WHERE i <= p_partkey % 13) AS DOUBLE), 9) AS prob FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(stats.binomial_cum(F.lit(12), (F.col("p_partkey") % 13).cast("int"), F.lit(0.3)), 9).alias("prob"))


@register("gcd", "SELECT o_orderkey, gcd(o_orderkey, o_custkey) AS g FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", stats.gcd("o_orderkey", "o_custkey").alias("g"))


@register("poisson_pmf", "SELECT p_size, round(CAST(4.0::DOUBLE ** p_size * exp(-4.0::DOUBLE) / gamma(p_size + 1.0) AS DOUBLE), 12) AS prob FROM part GROUP BY p_size")
def _(spark, sf):
    return table(spark, sf, "part").select("p_size").distinct().select("p_size", F.round(stats.poisson(F.lit(4.0), F.col("p_size")), 12).alias("prob"))


@register("primes", "WITH n AS (SELECT unnest(range(2, 2000)) AS p) SELECT p FROM n WHERE NOT EXISTS (SELECT 1 FROM n d WHERE d.p * d.p <= n.p AND n.p % d.p = 0)")
def _(spark, sf):
    return stats.primes(spark, 2000)


@register("factor_factorial", "WITH n AS (SELECT unnest(range(2, 101)) AS p), q AS (SELECT p FROM n WHERE NOT EXISTS (SELECT 1 FROM n d WHERE d.p * d.p <= n.p AND n.p % d.p = 0)) SELECT a.n, p, CAST(list_sum(list_transform(range(1, 8), lambda j: a.n // CAST(p ** j AS BIGINT))) AS BIGINT) AS e FROM (SELECT unnest(range(2, 101)) AS n) a JOIN q ON p <= a.n")
def _(spark, sf):
    return stats.factorial_primes(spark.range(2, 101).withColumnRenamed("id", "n"), limit=100)


@register("merge_primes", "SELECT p_partkey, 2 + p_partkey % 5 AS two, 3 - 1 AS three, CAST(round(2.0 ** (2 + p_partkey % 5) * 9) AS BIGINT) AS product FROM part")
def _(spark, sf):
    a = F.create_map(F.lit(2), F.lit(2).cast("long"), F.lit(3), F.lit(3).cast("long"))
    b = F.create_map(F.lit(2), F.col("p_partkey") % 5, F.lit(3), F.lit(-1).cast("long"))
    m = stats.merge_primes(a, b)
    return table(spark, sf, "part").select("p_partkey", m[2].alias("two"), m[3].cast("int").alias("three"), F.round(stats.expand_primes(m)).cast("long").alias("product"))


@register("gamma_beta", "SELECT p_size, round(gamma(p_size / 4.0::DOUBLE) / 1e6, 6) AS g, round(lgamma(p_size / 4.0::DOUBLE), 9) AS lg FROM part GROUP BY p_size")
def _(spark, sf):
    x = F.col("p_size") / 4.0
    return table(spark, sf, "part").select("p_size").distinct().select("p_size", F.round(stats.gamma(x) / 1e6, 6).alias("g"), F.round(stats.log_gamma(x), 9).alias("lg"))


@register("incomplete_functions")
def _(spark, sf):
    x = (F.col("p_size") + 1) / 60.0
    return table(spark, sf, "part").select("p_size").distinct().select("p_size", stats.ibeta(F.lit(2.5), F.lit(4.0), x).alias("ib"), stats.pbeta(x, 2.0, 3.0).alias("pb"), stats.beta(x, 2.0).alias("b"), stats.lower_gamma(F.lit(3.0), x * 10).alias("lo"), stats.upper_gamma(F.lit(3.0), x * 10).alias("up"), stats.student_cdf(x, 7.0).alias("t"))


@register("rng_normal")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", stats.normal(5.0, 2.0, 11).alias("n"), stats.exponential(3.0, 12).alias("e"), stats.weibull(2.0, 1.5, 13).alias("w"), stats.gamma_variate("p_partkey", 2.0, 1.0, 14).alias("g"), stats.beta_variate("p_partkey", 2.0, 3.0, 15).alias("b"))


# -- top-k, positions, tables


@register("topk_max", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@register("topk_min", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(25)


@register("queue_peek", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS top, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("top"), F.count(F.lit(1)).alias("n"))


@register("zip_with_pad", "WITH a AS (SELECT id, i, substr(p_name, i, 1) AS a FROM (SELECT p_partkey AS id, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)), b AS (SELECT id, i, substr(p_brand, i, 1) AS b FROM (SELECT p_partkey AS id, p_brand, unnest(range(1, length(p_brand) + 1)) AS i FROM part)) SELECT id, i - 1 AS i, a, b FROM a FULL JOIN b USING (id, i)")
def _(spark, sf):
    chars = lambda c: F.split(c, "")
    z = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.arrays_zip(chars("p_name").alias("a"), chars("p_brand").alias("b"))).alias("i", "x"))
    return z.select("id", F.col("i").cast("long").alias("i"), "x.a", "x.b")


@register("tsv_cell", "SELECT n_name AS cell FROM nation WHERE n_nationkey = 7")
def _(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("n_nationkey")) - 1
    return table(spark, sf, "nation").withColumn("row", n).filter("row = 7").select(F.col("n_name").alias("cell"))


@register("config_parse", "SELECT 'k' || (s_suppkey % 10) AS key, arg_max(s_name, s_suppkey) AS value FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY ALL")
def _(spark, sf):
    comment = F.when(F.col("s_suppkey") % 7 == 0, "# ").otherwise("")
    lines = table(spark, sf, "supplier").select("s_suppkey", F.concat(comment, F.lit(" k"), (F.col("s_suppkey") % 10).cast("string"), F.lit(" = "), F.col("s_name")).alias("value"))
    return formats.config(lines, order="s_suppkey")


@register("result_collect", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS ok, string_agg(CASE WHEN o_totalprice <= 1000 THEN 'low ' || o_orderkey END, ',' ORDER BY o_orderkey) AS messages FROM orders GROUP BY o_custkey")
def _(spark, sf):
    from .functions.result import checked, collected

    x = checked(F.col("o_orderkey"), [(F.col("o_totalprice") > 1000, F.concat(F.lit("low "), F.col("o_orderkey").cast("string")))])
    c = collected(table(spark, sf, "orders").select("o_custkey", "o_orderkey", x.alias("r")), "o_custkey", "r", "o_orderkey")
    return c.select("o_custkey", "ok", F.when(F.size("messages") > 0, F.array_join("messages", ",")).alias("messages"))


_IDENTITY = "   A  C  G  T  *\nA  5 -4 -4 -4 -2\nC -4  5 -4 -4 -2\nG -4 -4  5 -4 -2\nT -4 -4 -4  5 -2\n* -2 -2 -2 -2  1"


@register("matrix_lookup", f"{with_('seqs')} SELECT id, CASE WHEN id % 9 = 0 THEN -2 WHEN substr(seq, 1, 1) = substr(seq, 2, 1) THEN 5 ELSE -4 END AS score FROM seqs")
def _(spark, sf):
    scores = formats.matrix(spark.createDataFrame([(_IDENTITY,)], "text string"))
    pairs = sequences(spark, sf).select("id", F.when(F.col("id") % 9 == 0, "?").otherwise(F.substring("seq", 1, 1)).alias("a"), F.substring("seq", 2, 1).alias("b"))
    return formats.lookup_score(pairs, scores).select("id", "score")


@register("fasta_string", f"{with_('genome')} SELECT CAST(chr AS VARCHAR) AS name, seq FROM genome")
def _(spark, sf):
    lines = formats.fasta_lines(genome(spark, sf).withColumn("chr", F.concat(F.col("chr").cast("string"), F.lit(" test"))), "chr")
    return formats.fasta_from_string(lines, "value")


@register("sgd_lines", f"{with_('features')} SELECT CAST(chr AS INT) AS chr, CAST(l AS INT) AS l, CAST(r AS INT) AS r, type, fwd, gene FROM features")
def _(spark, sf):
    from .plans.synth import features

    f = features(spark, sf).withColumn("sys_name", F.col("gene")).withColumn("id", F.col("id").cast("string"))
    return formats.sgd_features(f.select(formats.sgd_line().alias("value"))).select("chr", "l", "r", "type", "fwd", "gene")


@register("vcf_lines", f"{_V} SELECT CAST(chr AS VARCHAR) AS chr, pos - 1 AS pos, ref, alt, qual, info FROM variants")
def _(spark, sf):
    return formats.vcf_lines(variants(spark, sf).select(formats.vcf_line().alias("value")))


# -- order and dynamic programming


@register("sw_align")
def _(spark, sf):
    # An alignment takes far longer than its row, so rows of one small file are dealt out.
    dealt = sequences(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    s = dealt.select("id", "seq", F.concat(F.substring("seq", 1, 30), F.lit("A"), F.substring("seq", 31, 34)).alias("other"))
    return s.select("id", alignment.aligned("seq", "other", 10, 20).alias("x")).select("id", "x.*")


@register("loopout_scar", f"{with_('seqs')} SELECT id, true AS ok, CASE WHEN id % 2 = 0 THEN substr(seq, 1, 30) END AS scar FROM seqs")
def _(spark, sf):
    repeat, spacer = F.substring("seq", 1, 30), F.substring("seq", 31, 34)
    s = F.when(F.col("id") % 2 == 0, F.concat(repeat, spacer, repeat)).otherwise(F.concat(repeat, spacer, spacer))
    return sequences(spark, sf).select("id", alignment.scars(s, 20, 60).alias("x")).select("id", "x.ok", "x.scar")


def _queries(spark, sf):
    g = genome(spark, sf)
    q = F.concat(F.substring("seq", 101, 40), F.lit("ACGTTGCA"), F.substring("seq", 161, 40))
    return g, g.select(F.col("chr").alias("query_id"), q.alias("query"))


_MATCHES = f"""{with_('genome')}, q AS (SELECT chr AS query_id, substr(seq, 101, 40) || 'ACGTTGCA' || substr(seq, 161, 40) AS s FROM genome), d AS (SELECT query_id, true AS fwd, s FROM q UNION ALL SELECT query_id, false, reverse(translate(s, 'ACGT', 'TGCA')) FROM q), w AS (SELECT query_id, fwd, i AS q, substr(s, i + 1, 20) AS w FROM (SELECT *, unnest(range(length(s) - 19)) AS i FROM d)), t AS (SELECT chr, i AS t, substr(seq, i + 1, 20) AS w FROM (SELECT *, unnest(range(length(seq) - 19)) AS i FROM genome)), h AS (SELECT query_id, chr, fwd, q, t - q AS d FROM w JOIN t USING (w)), r AS (SELECT *, q - row_number() OVER (PARTITION BY query_id, chr, fwd, d ORDER BY q) AS run FROM h),
    m AS (SELECT query_id, chr, fwd, min(q) AS q_l, min(q) + d AS t_l, max(q) - min(q) + 20 AS n FROM r GROUP BY query_id, chr, fwd, d, run)"""


@register("exact_match_genome", f"{_MATCHES} SELECT * FROM m")
def _(spark, sf):
    g, q = _queries(spark, sf)
    return alignment.match_runs(g, q, 20).select("query_id", "chr", "fwd", *(F.col(c).cast("long").alias(c) for c in ("q_l", "t_l", "n")))


#: One match of each query, chromosome and strand at a time; the anchors so far go along.
_CLUSTERS = f"""{_MATCHES}, o AS (SELECT *, t_l - q_l AS d, CASE WHEN fwd THEN q_l ELSE 88 - q_l - n END AS q FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, chr, fwd ORDER BY q, t_l) AS k,
        CASE WHEN fwd THEN t_l - q ELSE t_l + n - 1 - (88 - q) END AS low FROM o),
    s AS (SELECT *, [{{'d': d, 'cluster': 0::BIGINT, 'low': low}}] AS anchors FROM k WHERE k = 1
        UNION ALL SELECT k.*, CASE WHEN len(list_filter(s.anchors, lambda a: abs(a.d - k.d) < 15)) > 0 THEN s.anchors ELSE list_append(s.anchors, {{'d': k.d, 'cluster': len(s.anchors)::BIGINT, 'low': k.low}}) END
        FROM s JOIN k ON s.query_id = k.query_id AND s.chr = k.chr AND s.fwd = k.fwd AND k.k = s.k + 1),
    e AS (SELECT query_id, chr, fwd, q_l, t_l, n, unnest(list_filter(anchors, lambda a: abs(a.d - d) < 15)) AS a FROM s)
    SELECT query_id, chr, fwd, q_l, t_l, n, a.cluster AS cluster, a.low AS inferred_l, a.low + 88 AS inferred_r FROM e""".replace("WITH ", "WITH RECURSIVE ", 1)


def _clusters(spark, sf):
    g, q = _queries(spark, sf)
    found = alignment.match_runs(g, q, 20).select("query_id", "chr", "fwd", *(F.col(c).cast("long").alias(c) for c in ("q_l", "t_l", "n")))
    return g, q, alignment.group_matches(found.join(q.select("query_id", F.length("query").alias("query_length")).hint("merge"), "query_id"), 15).drop("query_length")


@register("group_matches", _CLUSTERS)
def _(spark, sf):
    return _clusters(spark, sf)[2]


@register("match_evaluate")
def _(spark, sf):
    g, q, found = _clusters(spark, sf)
    return alignment.evaluated(found, g, q, 15)


@register("dna_from_keys", f"SELECT c_custkey, {sql_dna32('c_custkey')} AS seq FROM customer")
def _(spark, sf):
    from .plans.synth import dna32

    return table(spark, sf, "customer").select("c_custkey", dna32(F.col("c_custkey")).alias("seq"))
