"""Registered queries over features, genes, PCR and codon usage, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dna
from .plans import codons, intervals, pcr, text
from .plans.synth import features, genome, points, primers, sequences, sql_revcomp, table, with_
from .queries_dna import _AA, sql_indices, sql_translate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


_F = with_("features", "points")
_INSIDE = "inside AS (SELECT point_id, pos, f.* FROM points p JOIN features f ON p.chr = f.chr AND pos BETWEEN l AND r)"
_NEAR = f"""{_F}, {_INSIDE}, lone AS (SELECT * FROM points WHERE point_id NOT IN (SELECT point_id FROM inside)),
    near AS (SELECT point_id, p.chr, pos, arg_min(struct_pack(l := f.l, r := f.r), struct_pack(d := CASE WHEN f.l > pos THEN f.l - pos ELSE pos - f.r END, s := CASE WHEN f.l > pos THEN 0 ELSE 1 END, t := CASE WHEN f.l > pos THEN f.r ELSE -f.l END)) AS x
        FROM lone p JOIN features f ON p.chr = f.chr GROUP BY ALL),
    found AS (SELECT * FROM inside UNION ALL SELECT point_id, pos, f.* FROM near n JOIN features f ON f.chr = n.chr AND f.l = n.x.l AND f.r = n.x.r)"""
_REL = "CASE WHEN fwd THEN CASE WHEN pos > r THEN pos - r + 100000 ELSE pos - l END ELSE CASE WHEN pos < l THEN l - pos + 100000 ELSE r - pos END END"


@register("feature_overlap", f"{_F}, {_INSIDE} SELECT point_id, id AS feature_id FROM inside")
def _(spark, sf):
    return intervals.overlapping(points(spark, sf), features(spark, sf)).select("point_id", F.col("id").alias("feature_id"))


@register("feature_find", f"{_NEAR} SELECT point_id, id AS feature_id FROM found")
def _(spark, sf):
    return intervals.find_features(points(spark, sf), features(spark, sf).select("id", "chr", "l", "r")).select("point_id", F.col("id").alias("feature_id"))


@register("nearest_gene", f"{_NEAR} SELECT point_id, id AS feature_id, {_REL} AS rel FROM found QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY type = 'ORF' DESC, length(description) DESC, id) = 1")
def _(spark, sf):
    return intervals.nearest_gene(points(spark, sf), features(spark, sf))


@register("feature_lookup", "WITH f AS (SELECT 'G' || (o_orderkey % 997) AS gene, o_orderkey AS id FROM orders) SELECT p_partkey, id FROM part JOIN f ON gene = 'G' || p_partkey WHERE p_partkey < 997")
def _(spark, sf):
    wanted = table(spark, sf, "part").filter("p_partkey < 997").select("p_partkey", F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"))
    return wanted.join(features(spark, sf).select("gene", "id"), "gene").select("p_partkey", "id")


@register("feature_subset", f"{with_('features')} SELECT * FROM features WHERE id IN (SELECT p_partkey FROM part)")
def _(spark, sf):
    return features(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", "left_semi")


@register("feature_lengths", f"{with_('features')} SELECT type, sum(r - l + 1)::BIGINT AS bases, max(r - l + 1) AS longest, count(*) AS n FROM features GROUP BY type")
def _(spark, sf):
    n = F.col("r") - F.col("l") + 1
    return features(spark, sf).groupBy("type").agg(F.sum(n).alias("bases"), F.max(n).alias("longest"), F.count(F.lit(1)).alias("n"))


@register("gene_structure_phase", "SELECT l_orderkey, l_linenumber, n_before, ((-n_before) % 3 + 3) % 3 AS phase FROM (SELECT l_orderkey, l_linenumber, coalesce(sum(l_partkey % 300 + 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_linenumber, l_partkey FROM lineitem))")
def _(spark, sf):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    cds = table(spark, sf, "lineitem").select("l_orderkey", number.alias("l_linenumber"), (F.col("l_partkey") % 300 + 3).alias("n"))
    return intervals.with_phase(cds, "l_orderkey", "l_linenumber", "n").select("l_orderkey", "l_linenumber", "n_before", F.col("phase").cast("long").alias("phase"))


@register("gene_structure_faults", f"{with_('features')}, c AS (SELECT *, coalesce(l <= lag(r) OVER (PARTITION BY gene ORDER BY l, r), false) AS late FROM features WHERE type = 'CDS') SELECT gene, bool_or(late) AS overlap, count(DISTINCT fwd) AS strands FROM c GROUP BY gene")
def _(spark, sf):
    return intervals.structure_faults(features(spark, sf).filter("type = 'CDS'"), "gene")


@register("gene_qc", f"{with_('seqs')}, s AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'ATG' || substr(seq, 1, 60) || 'TAA' ELSE seq END AS seq FROM seqs), a AS (SELECT id, seq, {sql_translate('seq')} AS aa FROM s) SELECT id, repeat('PREMATURE_STOP,', len(list_filter(string_split(substr(aa, 1, length(aa) - 1), ''), lambda x: x = '*'))) || CASE WHEN length(seq) % 3 <> 0 THEN 'LENGTH_NOT_MULT_OF_3,' ELSE '' END || CASE WHEN substr(aa, 1, 1) <> 'M' THEN 'STRANGE_START_CODON,' ELSE '' END || CASE WHEN substr(aa, -1, 1) <> '*' THEN 'MISSING_STOP_CODON,' ELSE '' END AS issues FROM a")
def _(spark, sf):
    s = F.when(F.col("id") % 3 == 0, F.concat(F.lit("ATG"), F.substring("seq", 1, 60), F.lit("TAA"))).otherwise(F.col("seq"))
    found = intervals.gene_issues(sequences(spark, sf).select("id", s.alias("seq")))
    return found.select("id", F.array_join(F.transform("issues", lambda x: F.concat(x, F.lit(","))), "").alias("issues"))


_ORF = f"""{with_('genome')}, st AS (SELECT chr, length(seq) AS n, fwd, CASE WHEN fwd THEN seq ELSE {sql_revcomp('seq')} END AS s FROM genome, (SELECT unnest([true, false]) AS fwd)),
    fr AS (SELECT chr, n, fwd, frame, substr(s, frame + 1) AS s FROM st, (SELECT unnest(range(3)) AS frame)), tr AS (SELECT chr, n, fwd, frame, string_split({sql_translate('s')}, '*') AS parts FROM fr),
    ex AS (SELECT chr, n, fwd, frame, len(parts) AS np, i, parts[i + 1] AS aa, coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x) + 1)), 0)::BIGINT AS off FROM tr, LATERAL (SELECT unnest(range(len(parts))) AS i)),
    ab AS (SELECT *, i < np - 1 AS stop, frame + off * 3 AS a, CASE WHEN i < np - 1 THEN frame + off * 3 + length(aa) * 3 + 2 ELSE n - 1 END AS b FROM ex),
    regions AS (SELECT chr, fwd, frame, CASE WHEN fwd THEN a ELSE n - 1 - b END AS l, CASE WHEN fwd THEN b ELSE n - 1 - a END AS r, aa, stop FROM ab WHERE a <= b)"""


@register("orf_six_frame", f"{_ORF} SELECT * FROM regions")
def orf_six_frame(spark, sf):
    r = intervals.coding_regions(genome(spark, sf))
    return r.select("chr", "fwd", F.col("frame").cast("long").alias("frame"), F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), "aa", "stop")


@register("orf_proper", f"{_ORF} SELECT chr, fwd, CASE WHEN fwd THEN l + (instr(aa, 'M') - 1) * 3 ELSE l END AS l, CASE WHEN fwd THEN r ELSE r - (instr(aa, 'M') - 1) * 3 END AS r, substr(aa, instr(aa, 'M')) AS aa FROM regions WHERE stop AND contains(aa, 'M')")
def _(spark, sf):
    r = intervals.proper_orfs(intervals.coding_regions(genome(spark, sf)))
    return r.select("chr", "fwd", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), "aa")


@register("gff3_export", f"""{with_('features')}, named AS (SELECT DISTINCT gene FROM features WHERE type = 'ORF'),
    own AS (SELECT *, ((-coalesce(sum(r - l + 1) OVER (PARTITION BY gene ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 3 + 3) % 3 AS phase FROM features WHERE type = 'CDS' AND gene IN (FROM named)),
    a AS (SELECT 1 AS section, 'gene' AS kind, '.' AS phase, id, chr, l, r, fwd, gene, description FROM features WHERE type = 'ORF' UNION ALL SELECT 2, 'CDS', CAST(CAST(phase AS INT) AS VARCHAR), id, chr, l, r, fwd, gene, description FROM own
        UNION ALL SELECT 3, 'CDS', '0', id, chr, l, r, fwd, gene, description FROM features WHERE type = 'CDS' AND gene NOT IN (FROM named))
    SELECT section, concat_ws(chr(9), a.chr, 'helixspark', kind, l + 1, r + 1, '.', CASE WHEN fwd THEN '+' ELSE '-' END, phase, 'ID=' || gene || ';Note=' || description) AS line FROM a""".replace("concat_ws(chr(9)", "concat_ws('\t'"))
def _(spark, sf):
    return intervals.gff3(features(spark, sf))


@register("orphan_cds_antijoin", f"{with_('features')} SELECT id, gene FROM features WHERE type = 'CDS' AND gene NOT IN (SELECT gene FROM features WHERE type = 'ORF')")
def _(spark, sf):
    f = features(spark, sf)
    return f.filter("type = 'CDS'").join(f.filter("type = 'ORF'").select("gene"), "gene", "left_anti").select("id", "gene")


_HITS = f"""{with_('genome', 'primers')}, b AS (SELECT primer_id, true AS fwd, primer AS s FROM primers UNION ALL SELECT primer_id, false, {sql_revcomp('primer')} FROM primers),
    hits AS (SELECT primer_id, chr, unnest({sql_indices('seq', 's')}) AS pos, fwd FROM b, genome WHERE contains(seq, s))"""


@register("pcr_primer_hits", f"{_HITS} SELECT * FROM hits")
def _(spark, sf):
    return pcr.primer_hits(genome(spark, sf), primers(spark, sf).select("primer_id", "primer")).select("primer_id", "chr", F.col("pos").cast("long").alias("pos"), "fwd")


def _pairs(spark, sf):
    p = primers(spark, sf)
    g = genome(spark, sf)
    at = (F.col("primer_id") % 400).cast("int")
    a, b = dna.substr("seq", at, 18), dna.revcomp(dna.substr("seq", at + 120, 18))
    return p.join(g.hint("merge"), "chr").select(F.col("primer_id").alias("pair_id"), F.when(F.col("primer_id") % 2 == 0, a).otherwise(b).alias("fwd_primer"), F.when(F.col("primer_id") % 2 == 0, b).otherwise(a).alias("rev_primer"))


_PAIRS = f"""{with_('genome', 'primers')}, w AS (SELECT primer_id, substr(seq, CAST(primer_id % 400 + 1 AS BIGINT), 18) AS a, {sql_revcomp('substr(seq, CAST(primer_id % 400 + 121 AS BIGINT), 18)')} AS b FROM primers JOIN genome USING (chr)),
    pairs AS (SELECT primer_id AS pair_id, CASE WHEN primer_id % 2 = 0 THEN a ELSE b END AS f, CASE WHEN primer_id % 2 = 0 THEN b ELSE a END AS r FROM w),
    k AS (SELECT chr, seq, unnest(range(length(seq) - 17)) AS pos FROM genome), m AS (SELECT chr, pos, substr(seq, pos + 1, 18) AS s FROM k),
    fh AS (SELECT pair_id, chr, pos, fwd FROM m JOIN (SELECT pair_id, true AS fwd, f AS s FROM pairs UNION ALL SELECT pair_id, false, {sql_revcomp('f')} FROM pairs) USING (s)),
    rh AS (SELECT pair_id, chr, pos, fwd FROM m JOIN (SELECT pair_id, false AS fwd, r AS s FROM pairs UNION ALL SELECT pair_id, true, {sql_revcomp('r')} FROM pairs) USING (s)),
    pr AS (SELECT a.pair_id, a.chr, a.fwd, a.pos AS ap, CASE WHEN a.fwd THEN a.pos ELSE b.pos END AS l, CASE WHEN a.fwd THEN b.pos + 17 ELSE a.pos + 17 END AS r FROM fh a JOIN rh b ON a.pair_id = b.pair_id AND a.chr = b.chr AND a.fwd = b.fwd
        WHERE CASE WHEN a.fwd THEN b.pos >= a.pos + 18 ELSE a.pos >= b.pos + 18 END AND CASE WHEN a.fwd THEN b.pos - a.pos ELSE a.pos - b.pos END + 18 <= 10000),
    best AS (SELECT pair_id, chr, fwd, l, r, r - l + 1 AS n FROM pr QUALIFY row_number() OVER (PARTITION BY pair_id, chr, fwd, ap ORDER BY r - l, l) = 1),
    products AS (SELECT pair_id, chr, l, r, n, bool_or(fwd) AS fwd FROM best GROUP BY ALL)"""


@register("pcr_products", f"{_PAIRS} SELECT * FROM products")
def _(spark, sf):
    p = pcr.products(genome(spark, sf), _pairs(spark, sf))
    return p.select("pair_id", "chr", *(F.col(c).cast("long").alias(c) for c in ("l", "r", "n")), "fwd")


@register("pcr_unique", f"{_PAIRS}, c AS (SELECT *, count(*) OVER w AS k, min(chr) OVER w = max(chr) OVER w AND max(n) OVER w - min(n) OVER w <= 10 AS alike, row_number() OVER (PARTITION BY pair_id ORDER BY chr, l, r) AS rk FROM products WINDOW w AS (PARTITION BY pair_id)) SELECT pair_id, chr, l, r FROM c WHERE rk = 1 AND (k = 1 OR k = 2 AND alike)")
def _(spark, sf):
    p = pcr.unique_product(pcr.products(genome(spark, sf), _pairs(spark, sf)))
    return p.select("pair_id", "chr", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))


@register("overlap_stitch", f"{with_('seqs')}, p AS (SELECT id, substr(seq, 1, 40) AS a, CASE WHEN id % 3 = 0 THEN substr(seq, 40) ELSE substr(seq, CAST(40 - id % 20 AS BIGINT)) END AS b FROM seqs), o AS (SELECT id, a, b, list_min(list_filter(range(8, least(length(a), length(b)) + 1), lambda n: right(a, n) = left(b, n))) AS n FROM p) SELECT id, a || substr(b, n + 1) AS merged FROM o")
def _(spark, sf):
    b = F.when(F.col("id") % 3 == 0, dna.substr("seq", 39, 64)).otherwise(dna.substr("seq", (F.lit(39) - F.col("id") % 20).cast("int"), 64))
    return sequences(spark, sf).select("id", pcr.stitched(F.substring("seq", 1, 40), b, 8).alias("merged"))


@register("stitch_request", f"{with_('seqs')} SELECT id, id % 2 = 0 AS ok, CASE WHEN id % 2 = 0 THEN seq END AS merged, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS n FROM seqs WHERE list_min(list_filter(range(10, 31), lambda n: right(substr(seq, 1, 40), n) = left(substr(seq, 21, 44), n))) = 20")
def _(spark, sf):
    s = sequences(spark, sf).select("id", "seq", F.substring("seq", 1, 40).alias("a"), dna.revcomp(F.substring("seq", 21, 44)).alias("b"), F.when(F.col("id") % 2 == 0, F.substring("seq", 1, 5)).otherwise(F.lit("X")).alias("ma"), dna.revcomp(F.substring("seq", 60, 5)).alias("mb"))
    x = pcr.stitch_request("a", "ma", "b", "mb", 10, 30)
    first = pcr.stitched(F.col("a"), dna.revcomp("b"), 10, 30)
    return s.filter(F.length(first) == 64).select("id", x["ok"].alias("ok"), x["value"].alias("merged"), F.size(x["messages"]).alias("n"))


_USE = f"""{with_('seqs')}, c AS (SELECT id, list_transform(range(21), lambda i: substr(seq, 3 * i + 1, 3)) AS cs, {sql_translate('seq')} AS aa FROM seqs WHERE id % 2 = 0),
    e AS (SELECT unnest(CASE WHEN contains(aa, '*') THEN cs[1:instr(aa, '*')] ELSE cs END) AS codon FROM c), cnt AS (SELECT codon, count(*) AS n FROM e GROUP BY codon),
    dim AS (SELECT a.b || b.b || d.b AS codon FROM (SELECT unnest(['T','C','A','G']) AS b) a, (SELECT unnest(['T','C','A','G']) AS b) b, (SELECT unnest(['T','C','A','G']) AS b) d),
    usage AS (SELECT codon, {_AA.format('codon', '0')} AS aa, coalesce(n, 0) AS n FROM dim LEFT JOIN cnt USING (codon)),
    tab AS (SELECT codon, aa, n * 1000.0 / sum(n) OVER () AS freq FROM usage),
    r1 AS (SELECT *, row_number() OVER (PARTITION BY aa ORDER BY freq DESC, codon) AS rank, greatest(freq, 1e-6) / sum(greatest(freq, 1e-6)) OVER (PARTITION BY aa) AS rel1 FROM tab),
    prep AS (SELECT *, rel1 / sum(rel1) OVER (PARTITION BY aa) AS rel2 FROM r1 WHERE rel1 >= 0.1 AND rank <= 4)"""


def _usage(spark, sf):
    return codons.usage(sequences(spark, sf), keep=F.col("id") % 2 == 0)


def _table(spark, sf):
    u = _usage(spark, sf)
    return u.crossJoin(F.broadcast(u.agg(F.sum("n").alias("total")))).select("codon", "aa", (F.col("n") * 1000.0 / F.col("total")).alias("freq"))


@register("codon_usage_count", f"{_USE} SELECT * FROM usage")
def _(spark, sf):
    return _usage(spark, sf)


@register("codon_prep_rank", f"{_USE} SELECT codon, aa, rank, round(rel1, 6) AS rel1, round(rel2, 6) AS rel2 FROM prep")
def _(spark, sf):
    return codons.ranked(_table(spark, sf), 0.1, 4).select("codon", "aa", F.col("rank").cast("long").alias("rank"), F.round("rel1", 6).alias("rel1"), F.round("rel2", 6).alias("rel2"))


@register("codon_opt", f"{_USE}, best AS (SELECT aa, codon FROM r1 WHERE rank = 1), p AS (SELECT id, {sql_translate('seq')} AS aa FROM seqs), x AS (SELECT id, i, substr(aa, i + 1, 1) AS aa FROM p, LATERAL (SELECT unnest(range(21)) AS i)) SELECT id, string_agg(codon, '' ORDER BY i) AS dna FROM x JOIN best USING (aa) GROUP BY id")
def _(spark, sf):
    return codons.optimised(sequences(spark, sf).select("id", dna.translate("seq").alias("protein")), "protein", _table(spark, sf)).select("id", "dna")


@register("codon_choose_cdf", f"{_USE}, cdf AS (SELECT *, sum(rel2) OVER (PARTITION BY aa ORDER BY rank DESC) AS cum FROM prep), d AS (SELECT id, substr({sql_translate('seq')}, 1, 1) AS aa, (id % 97) / 100.0 + 0.0037 AS r FROM seqs) SELECT id, d.aa, arg_min(codon, cum) AS codon FROM d JOIN cdf c ON c.aa = d.aa AND cum > r GROUP BY id, d.aa")
def _(spark, sf):
    draws = sequences(spark, sf).select("id", F.substring(dna.translate("seq"), 1, 1).alias("aa"), ((F.col("id") % 97) / 100.0 + 0.0037).alias("r"))
    return codons.chosen(draws, codons.ranked(_table(spark, sf), 0.1, 4)).select("id", "aa", "codon")


@register("codon_table_kazusa", f"{_USE} SELECT instr('TCAG', substr(codon, 1, 1)) AS block, instr('TCAG', substr(codon, 3, 1)) AS line, string_agg(printf('%s%5.1f(%6d)', translate(codon, 'T', 'U'), n * 1000.0 / t, n), '  ' ORDER BY instr('TCAG', substr(codon, 2, 1))) AS text FROM (SELECT *, CAST(sum(n) OVER () AS DOUBLE) AS t FROM usage) GROUP BY ALL")
def _(spark, sf):
    return codons.kazusa(_usage(spark, sf)).select(F.col("block").cast("long").alias("block"), F.col("line").cast("long").alias("line"), "text")


@register("codon_table_gcg", f"{_USE} SELECT aa, codon, printf('%s %10.2f %10.2f', codon, CAST(n AS DOUBLE), n * 1000.0 / t) AS text FROM (SELECT *, CAST(sum(n) OVER () AS DOUBLE) AS t FROM usage)")
def _(spark, sf):
    return codons.gcg(_usage(spark, sf)).select("aa", "codon", F.regexp_replace("text", r"^\w+ (.*) +\S+$", "$1").alias("text")).withColumn("text", F.rtrim("text"))


@register("codon_table_parse", "SELECT codon, freq FROM (VALUES ('GGT', 17.6), ('GGC', 9.8), ('TTT', 26.1), ('TTC', 18.4), ('CTG', 10.5)) t(codon, freq)".replace("17.6)", "17.6::DOUBLE)").replace("freq FROM", "CAST(freq AS DOUBLE) AS freq FROM"))
def _(spark, sf):
    lines = spark.createDataFrame([("GGU 17.6( 1234)  GGC  9.8(  99)",), ("",), ("UUU26.1(170666)  UUC18.4(120510)  CUG10.5( 6)",)], "value string")
    return codons.parse_codon_table(lines)


@register("lines_concat", "SELECT s_nationkey, string_agg(s_name, chr(10) ORDER BY s_suppkey, s_name) AS s_name FROM supplier GROUP BY ALL")
def _(spark, sf):
    return text.concat_ordered(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_name", "\n")
