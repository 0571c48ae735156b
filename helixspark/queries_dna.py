"""Registered queries over sequence expressions, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dna, tables
from .plans.synth import genome, sequences, sql_revcomp, table, with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


_S = with_("seqs")
_CODE = tables.AMINO_ACIDS
_AA = f"substr('{_CODE}', CAST(16 * (instr('TCAG', substr({{0}}, {{1}} + 1, 1)) - 1) + 4 * (instr('TCAG', substr({{0}}, {{1}} + 2, 1)) - 1) + instr('TCAG', substr({{0}}, {{1}} + 3, 1)) AS BIGINT), 1)"


def sql_translate(s: str) -> str:
    return f"array_to_string(list_transform(range(length({s}) // 3), lambda i: {_AA.format(s, '3 * i')}), '')"


def sql_indices(s: str, q: str) -> str:
    return f"list_filter(range(length({s}) - length({q}) + 1), lambda i: substr({s}, i + 1, length({q})) = {q})"


def joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")


@register("dna_revcomp", f"{_S} SELECT id, {sql_revcomp('seq')} AS rc FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", dna.revcomp("seq").alias("rc"))


@register("dna_revcomp_if", f"{_S} SELECT id, CASE WHEN id % 3 = 0 THEN {sql_revcomp('seq')} ELSE seq END AS s FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", dna.revcomp_if(F.col("id") % 3 == 0, "seq").alias("s"))


@register("dna_revcomp_plain", f"{_S} SELECT id, reverse(translate(lower(substr(seq, 1, 20)) || ' ' || seq, 'TtCcAaGg', 'AaGgTtCc')) AS rc FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", dna.revcomp_plain(F.concat(F.lower(F.substring("seq", 1, 20)), F.lit(" "), F.col("seq"))).alias("rc"))


@register("dna_complement_strict", f"{_S} SELECT id, translate(seq, 'ACGT', 'TGCA') AS c FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", dna.complement(F.lower("seq"), strict=True).alias("c"))


@register("dna_translate", f"{_S} SELECT id, {sql_translate('seq')} AS protein FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", dna.translate("seq").alias("protein"))


@register("codon_to_trigram", f"""{_S}, c AS (SELECT id, unnest(range(length(seq) // 3)) AS i, seq FROM seqs), a AS (SELECT {_AA.format('seq', '3 * i')} AS aa FROM c)
    SELECT CASE aa {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.TRIGRAMS.items())} END AS trigram, count(*) AS n FROM a GROUP BY ALL""")
def _(spark, sf):
    aa = F.explode(F.split(dna.translate("seq"), "")).alias("aa")
    return sequences(spark, sf).select(aa).filter("aa <> ''").groupBy(dna.trigram("aa").alias("trigram")).agg(F.count(F.lit(1)).alias("n"))


@register("codon_dimension", f"""SELECT c, {_AA.format('c', '0')} AS aa FROM (SELECT a.b || b.b || d.b AS c FROM (SELECT unnest(['T','C','A','G']) AS b) a, (SELECT unnest(['T','C','A','G']) AS b) b, (SELECT unnest(['T','C','A','G']) AS b) d)""")
def _(spark, sf):
    from .plans.codons import codons

    return codons(spark).select(F.col("codon").alias("c"), "aa")


@register("dna_validate", f"{_S} SELECT id, upper(s) AS seq, regexp_matches(s, '^[ACGTacgt]*$') AS strict FROM (SELECT id, CASE WHEN id % 5 = 0 THEN seq || 'N' ELSE lower(seq) END AS s FROM seqs)")
def _(spark, sf):
    s = F.when(F.col("id") % 5 == 0, F.concat("seq", F.lit("N"))).otherwise(F.lower("seq"))
    return sequences(spark, sf).select("id", dna.validated(s, "ambiguous").alias("seq"), dna.is_dna(s, strict=True).alias("strict"))


@register("dna_slice_split", f"{_S} SELECT id, substr(seq, 6, 10) AS middle, substr(seq, 11, 1) AS item, substr(seq, 1, 11) AS head, substr(seq, 12) AS tail FROM seqs")
def _(spark, sf):
    parts = dna.split_after("seq", 10)
    return sequences(spark, sf).select("id", dna.piece("seq", 5, 14).alias("middle"), dna.item("seq", 10).alias("item"), parts["head"].alias("head"), parts["tail"].alias("tail"))


@register("dna_indices_of", f"{_S} SELECT id, array_to_string({sql_indices('seq', chr(39) + 'AA' + chr(39))}, ',') AS at FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", joined(dna.indices_of("seq", F.lit("AA"))).alias("at"))


@register("dna_concat", f"{_S} SELECT id % 100 AS g, string_agg(seq, '' ORDER BY id) AS seq FROM seqs GROUP BY ALL")
def _(spark, sf):
    from .plans.text import concat_ordered

    return concat_ordered(sequences(spark, sf).withColumn("g", F.col("id") % 100), "g", "id", "seq")


@register("dna_predicates", f"{_S} SELECT id, starts_with(seq, 'A') AS sw, ends_with(seq, 'T') AS ew, contains(seq, 'ACG') AS has FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", F.col("seq").startswith("A").alias("sw"), F.col("seq").endswith("T").alias("ew"), F.col("seq").contains("ACG").alias("has"))


@register("dna_order", f"{_S} SELECT id, row_number() OVER (ORDER BY length(s), s, id) AS rank FROM (SELECT id, substr(seq, 1, CAST(id % 40 + 1 AS BIGINT)) AS s FROM seqs)")
def _(spark, sf):
    from .plans.text import ranked

    s = F.substring("seq", F.lit(1), (F.col("id") % 40 + 1).cast("int"))
    return ranked(sequences(spark, sf).select("id", s.alias("s")), [*dna.dna_order("s"), F.col("id")]).select("id", "rank")


@register("fasta_format60", "SELECT doc_id, array_to_string(regexp_extract_all(replace(text, chr(10), ' '), '(?s).{1,60}'), chr(10)) AS wrapped FROM documents")
def _(spark, sf):
    t = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", dna.wrap(t).alias("wrapped"))


@register("strip_newlines", "SELECT doc_id, md5(replace(replace(replace(text, chr(10), ''), chr(13), ''), ' ', '')) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(dna.strip_newlines("text").cast("binary")).alias("digest"))


@register("md5_hash", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@register("case_of_bases", f"{_S} SELECT id, translate(seq, 'ACGT', 'acgt') AS lo, translate(lower(seq) || 'nN', 'acgt', 'ACGT') AS up FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", dna.lower_bases("seq").alias("lo"), dna.upper_bases(F.concat(F.lower("seq"), F.lit("nN"))).alias("up"))


@register("path_parts", "SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS base, regexp_replace(url, '/[^/]*$', '') AS dir, regexp_replace(url, '\\.[^.]*$', '') || '.gff' AS other FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", dna.base_name("url").alias("base"), dna.base_dir("url").alias("dir"), dna.replace_suffix("url", ".gff").alias("other"))


@register("chromosome_names", "SELECT s_suppkey, CASE WHEN s_suppkey % 18 = 17 THEN 17 ELSE s_suppkey % 16 + 1 END AS chr FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 18 == 17, F.lit("ref|NC_001224|")).when(k % 2 == 0, F.format_string("ref|NC_%06d|", k % 16 + 1133)).otherwise((k % 16 + 1).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", dna.chromosome_number(name).alias("chr"))


@register("gc_content", f"{_S} SELECT id, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / 64.0, 6) AS gc FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", F.round(dna.gc("seq"), 6).alias("gc"))


@register("gcn_prefix", f"{_S} SELECT id, round(length(regexp_replace(substr(seq, 1, 20), '[^GC]', '', 'g')) / 20.0, 6) AS gc FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", F.round(dna.gc_first("seq", 20), 6).alias("gc"))


@register("polyrun_flag", f"{_S} SELECT id, {' OR '.join([f'contains(seq, repeat({chr(39)}{b}{chr(39)}, 4))' for b in 'ACGT'] + [f'contains(seq, repeat({chr(39)}{a}{b}{chr(39)}, 4))' for a in 'ACGT' for b in 'ACGT'])} AS run, contains(seq, 'GGGG') AS g_run FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", dna.has_polyrun("seq", 4).alias("run"), dna.has_g_run("seq", 4).alias("g_run"))


@register("self_complement", f"{_S}, w AS (SELECT id, unnest(range(61)) AS pos, seq FROM seqs) SELECT id, pos, substr(seq, pos + 1, 4) AS word FROM w WHERE substr(seq, pos + 1, 4) = {sql_revcomp('substr(seq, pos + 1, 4)')}")
def _(spark, sf):
    words = sequences(spark, sf).select("id", F.explode(dna.kmers("seq", 4)).alias("k")).select("id", F.col("k.pos").cast("long").alias("pos"), F.col("k.kmer").alias("word"))
    return words.filter(dna.self_complementary("word"))


@register("kmer_encode", f"{_S} SELECT id, CAST(list_sum(list_transform(range(20), lambda i: CAST(instr('GATC', substr(seq, i + 1, 1)) - 1 AS BIGINT) * CAST(pow(4, 19 - i) AS BIGINT))) AS VARCHAR) AS n FROM seqs")
def _(spark, sf):
    return sequences(spark, sf).select("id", dna.kmer_number(F.substring("seq", 1, 20)).cast("string").alias("n"))


@register("kmer_canonical_count", f"""{_S}, k AS (SELECT substr(seq, i + 1, 8) AS k FROM (SELECT seq, unnest(range(57)) AS i FROM seqs)),
    c AS (SELECT least(translate(k, 'GATC', '0123'), reverse(translate(k, 'CTAG', '0123'))) AS kmer FROM k) SELECT kmer, least(count(*), 2) AS state FROM c GROUP BY kmer""")
def _(spark, sf):
    from .plans.kmers import kmer_index

    return kmer_index(sequences(spark, sf), "seq", 8).select("kmer", "state")


@register("mer32_search", f"""{_S}, k AS (SELECT substr(seq, i + 1, 32) AS k FROM (SELECT seq, unnest(range(33)) AS i FROM seqs WHERE id % 2 = 0)),
    ix AS (SELECT least(translate(k, 'GATC', '0123'), reverse(translate(k, 'CTAG', '0123'))) AS kmer, least(count(*), 2) AS state FROM k GROUP BY ALL),
    q AS (SELECT id, CASE WHEN id % 3 = 0 THEN {sql_revcomp('seq')} ELSE seq END AS s FROM seqs), qk AS (SELECT id, i, substr(s, i + 1, 32) AS k FROM (SELECT id, s, unnest(range(33)) AS i FROM q)),
    h AS (SELECT id, min(i) AS i, arg_min(state, i) AS state FROM qk JOIN ix ON least(translate(k, 'GATC', '0123'), reverse(translate(k, 'CTAG', '0123'))) = kmer GROUP BY id)
    SELECT q.id, CASE state WHEN 1 THEN 'ONCE' WHEN 2 THEN 'TWICE' ELSE 'NONE' END AS result, coalesce(i, -1) AS pos FROM q LEFT JOIN h USING (id)""")
def _(spark, sf):
    from .plans.kmers import kmer_index, kmer_search

    s = sequences(spark, sf)
    queries = s.select("id", F.when(F.col("id") % 3 == 0, dna.revcomp("seq")).otherwise(F.col("seq")).alias("seq"))
    return kmer_search(queries, "id", "seq", kmer_index(s.filter("id % 2 = 0"), "seq", 32), 32)


@register("substring_find_all", f"SELECT doc_id, array_to_string({sql_indices('t', 'q')}, ',') AS at FROM (SELECT doc_id, text AS t, 'th' AS q FROM documents WHERE length(text) >= 2)")
def _(spark, sf):
    return table(spark, sf, "documents").filter(F.length("text") >= 2).select("doc_id", joined(dna.indices_of("text", F.lit("th"))).alias("at"))


@register("substring_count_all", f"SELECT doc_id, len({sql_indices('t', 'q')}) AS n FROM (SELECT doc_id, text AS t, 'the' AS q FROM documents WHERE length(text) >= 3)")
def _(spark, sf):
    return table(spark, sf, "documents").filter(F.length("text") >= 3).select("doc_id", dna.count_of("text", F.lit("the")).cast("long").alias("n"))


@register("longest_prefix_match", f"{_S} SELECT a.id, len(list_filter(range(1, 65), lambda n: contains(b.seq, substr(a.seq, 1, n)))) AS n FROM seqs a JOIN seqs b ON b.id = a.id + 1")
def _(spark, sf):
    s = sequences(spark, sf)
    other = s.select((F.col("id") - 1).alias("id"), F.col("seq").alias("text"))
    return s.join(other, "id").select("id", dna.longest_prefix("text", "seq").cast("long").alias("n"))


@register("indel_equality", f"""{_S}, p AS (SELECT id, substr(seq, 1, 12) AS a, CASE id % 4 WHEN 0 THEN substr(seq, 1, 12) WHEN 1 THEN substr(seq, 1, 5) || 'A' || substr(seq, 6, 7) WHEN 2 THEN substr(seq, 1, 12) || 'A' ELSE substr(seq, 2, 12) END AS b FROM seqs)
    SELECT id, CASE WHEN a = b THEN 'Equal' WHEN len(list_filter(range(1, 12), lambda i: length(b) = length(a) + 1 AND substr(a, 1, i) || substr(b, i + 1, 1) || substr(a, i + 1) = b AND NOT starts_with(b, a) )) > 0 THEN 'EqualWithIndel' ELSE 'NotEqual' END AS kind FROM p""")
def _(spark, sf):
    a = F.substring("seq", 1, 12)
    case = F.col("id") % 4
    b = F.when(case == 0, a).when(case == 1, F.concat(F.substring("seq", 1, 5), F.lit("A"), F.substring("seq", 6, 7))).when(case == 2, F.concat(a, F.lit("A"))).otherwise(F.substring("seq", 2, 12))
    return sequences(spark, sf).select("id", dna.equal_with_indel(a, b).alias("kind"))


_GAPPED = "regexp_replace(substr(seq, 1, 30), 'A', '-', 'g')"


def _rows(spark, sf):
    other = F.substring("seq", 31, 30)
    return sequences(spark, sf).select("id", F.regexp_replace(F.substring("seq", 1, 30), "A", "-").alias("a"), F.regexp_replace(other, "C", "-").alias("b"))


_ROWS = f"{_S}, r AS (SELECT id, {_GAPPED} AS a, regexp_replace(substr(seq, 31, 30), 'C', '-', 'g') AS b FROM seqs)"
_LEAD, _TAIL = "(length({0}) - length(ltrim({0}, '-')))", "(length(rtrim({0}, '-')) - 1)"


@register("alignment_mismatches", f"{_ROWS} SELECT id, len(list_filter(range(30), lambda i: i >= {_LEAD.format('b')} AND i <= {_TAIL.format('b')} AND substr(a, i + 1, 1) <> substr(b, i + 1, 1))) AS n, array_to_string(list_filter(range(30), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1)), ',') AS at FROM r")
def _(spark, sf):
    return _rows(spark, sf).select("id", dna.count_mismatches("a", "b").cast("long").alias("n"), joined(dna.mismatch_positions("a", "b")).alias("at"))


@register("alignment_bounds", f"{_ROWS} SELECT id, greatest({_LEAD.format('a')}, {_LEAD.format('b')}) AS first, least({_TAIL.format('a')}, {_TAIL.format('b')}) AS last FROM r")
def _(spark, sf):
    x = dna.alignment_bounds("a", "b")
    return _rows(spark, sf).select("id", x["first"].cast("long").alias("first"), x["last"].cast("long").alias("last"))


@register("coord_aln2seq", f"{_ROWS} SELECT id, array_to_string(list_transform(range(30), lambda i: CASE WHEN substr(a, i + 1, 1) = '-' THEN '.' ELSE CAST(4 + length(replace(substr(a, 1, i + 1), '-', '')) AS VARCHAR) END), ',') AS at FROM r")
def _(spark, sf):
    return _rows(spark, sf).select("id", joined(dna.aln_to_seq("a", 5)).alias("at"))


@register("coord_seq2aln", f"{_ROWS}, c AS (SELECT id, list_filter(range(30), lambda i: substr(a, i + 1, 1) <> '-') AS c FROM r) SELECT id, array_to_string(list_transform(range(36), lambda i: CASE WHEN i < 3 OR i - 3 >= len(c) THEN '.' ELSE CAST(c[i - 2] AS VARCHAR) END), ',') AS at FROM c")
def _(spark, sf):
    return _rows(spark, sf).select("id", joined(dna.seq_to_aln("a", 3, 36)).alias("at"))


@register("alignment_locate", f"{_S} SELECT id, 9 AS l, 28 AS r FROM seqs WHERE instr(seq, substr(seq, 10, 20)) = 10")
def _(spark, sf):
    x = dna.locate_alignment(F.concat(F.substring("seq", 10, 8), F.lit("--"), F.substring("seq", 18, 12)), "seq")
    return sequences(spark, sf).select("id", x["l"].alias("l"), x["r"].alias("r")).filter("l = 9")


@register("mismatched_tails", f"{_S}, p AS (SELECT id, substr(seq, 1, 10) AS a, substr(seq, 1, CAST(id % 8 AS BIGINT)) || substr(seq, 20, 6) AS b FROM seqs), n AS (SELECT *, len(list_filter(range(1, 11), lambda n: length(b) >= n AND substr(a, 1, n) = substr(b, 1, n))) AS n FROM p) SELECT id, substr(a, n + 1) AS tail_a, substr(b, n + 1) AS tail_b FROM n")
def _(spark, sf):
    x = dna.mismatched_tails(F.substring("seq", 1, 10), F.concat(F.substring("seq", F.lit(1), (F.col("id") % 8).cast("int")), F.substring("seq", 20, 6)))
    return sequences(spark, sf).select("id", x["tail_a"].alias("tail_a"), x["tail_b"].alias("tail_b"))


@register("genome_bases", f"{with_('genome')} SELECT chr, b, count(*) AS n FROM (SELECT chr, unnest(string_split(seq, '')) AS b FROM genome) WHERE b <> '' GROUP BY ALL")
def _(spark, sf):
    return genome(spark, sf).select("chr", F.explode(F.split("seq", "")).alias("b")).filter("b <> ''").groupBy("chr", "b").agg(F.count(F.lit(1)).alias("n"))
