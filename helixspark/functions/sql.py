"""The sequence functions for SQL text: temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import tables

_FROM, _TO = (x.replace("\n", "\\n").replace("\r", "\\r") for x in tables.COMPLEMENT)

FUNCTIONS = {
    "revcomp": ("s STRING", "STRING", f"reverse(translate(s, '{_FROM}', '{_TO}'))"),
    "gc_content": ("s STRING", "DOUBLE", "regexp_count(s, '[GCgc]') / nullif(length(s), 0)"),
    "codon_aa": ("c STRING", "STRING", f"CASE WHEN upper(c) RLIKE '^[ACGT]{{3}}$' THEN substr('{tables.AMINO_ACIDS}', 16 * (instr('TCAG', substr(upper(c), 1, 1)) - 1) + 4 * (instr('TCAG', substr(upper(c), 2, 1)) - 1) + instr('TCAG', substr(upper(c), 3, 1)), 1) WHEN upper(c) RLIKE '^[ACGTN]{{3}}$' THEN '?' END"),
    "wrap60": ("s STRING", "STRING", "regexp_replace(s, '(.{60})(?=.)', '$1\\n')"),
    "canonical_kmer": ("k STRING", "STRING", "least(translate(k, 'GATC', '0123'), reverse(translate(k, 'CTAG', '0123')))"),
    "variant_kind": ("ref STRING, alt STRING", "STRING", "CASE WHEN length(ref) <> length(alt) THEN 'INDEL' WHEN length(ref) = 1 THEN 'SNP' ELSE 'MNP' END"),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
