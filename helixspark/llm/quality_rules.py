"""Quality rules as a ledger of bitmasks.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit per failed rule. Policies are
versioned masks over those bits, applied to the stored ledger without touching the texts again, and ablations come from counts by
mask, of which there are at most two to the number of rules. Windows are compared word by word where their hashes agree.

Defined results: null and empty texts have no words and fail few_words. Rows are judged by themselves, so ties, repeated
rows and null identifiers make no difference; very long texts are measured whole; an empty table gives an empty ledger. Other columns are carried along,
except those named as the ledger's own, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, staged, text_of
from .words import slices, words_of

# The symbols that are counted, and the words of a window.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words"]

#: Name and SQL condition of failure, by bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeats", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("upper_case", "2 * n_upper_words > n_words"),
    ("long_words", "word_chars > 40 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeats"]
#: Versions of the policy: the rules that count.
POLICIES = {"base": BASE, "v1": sum(BITS.values())}


def repeat_words(words: list[str], lengths: np.ndarray) -> np.ndarray:
    """For each text the number of its words that lie in windows found twice or more in it. words: of all texts in turn."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(len(lengths), dtype=np.int64)
    number = pd.factorize(np.array(words, dtype=object))[0]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    m = n - WINDOW + 1
    odd = np.random.default_rng(11).integers(1, 2**63, WINDOW + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = (doc[:m] + 1).astype(np.uint64) * odd[WINDOW]
    for j in range(WINDOW):
        h = number[j : m + j].astype(np.uint64) + np.uint64(1)
        key += (h ^ (h << np.uint64(17))) * odd[j]
    inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    order = np.argsort(key[inside], kind="stable")

    def equal(order: np.ndarray) -> np.ndarray:
        """Whether neighbours in this order are the same window of the same text."""
        at = inside[order]
        out = doc[at[1:]] == doc[at[:-1]]
        for j in range(WINDOW):
            out &= number[at[1:] + j] == number[at[:-1] + j]
        return out

    own = equal(order)
    if (own != (key[inside][order][1:] == key[inside][order][:-1])).any():  # different windows of one hash may lie between equal ones
        order = np.lexsort([*(number[inside + j] for j in range(WINDOW)), doc[inside]])
        own = equal(order)
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = own
    found = inside[order[same[1:] | same[:-1]]]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    hit = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[hit], minlength=len(lengths))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    split = [words_of(x) for x in texts]
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = [w for ws in split for w in ws]
    lines = [[y for y in x.split("\n") if y and words_of(y)] for x in texts]
    return {
        "n_words": lengths,
        "word_chars": np.array([sum(map(len, ws)) for ws in split], dtype=np.int64),
        "n_symbols": np.array([sum(map(x.count, SYMBOLS)) for x in texts], dtype=np.int64),
        "n_lines": np.array([len(x) for x in lines], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": repeat_words(flat, lengths),
        "n_upper_words": np.array([sum(map(str.isupper, ws)) for ws in split], dtype=np.int64),
    }


def _measured(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{x} long" for x in MEASURES))
    def f(column: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame(measure(x)) for x in slices(column.tolist())]
        return pd.concat(parts) if parts else pd.DataFrame({x: pd.Series(dtype="int64") for x in MEASURES})

    return f(text)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements and failed, the bits of the rules that fail."""
    ship(docs.sparkSession)
    own = [*MEASURES, "failed"]
    out = docs.drop(*(x for x in own if x != text_col)).withColumn("__measured", _measured(text_of(text_col)))
    for x in MEASURES:
        out = out.withColumn(x, F.col(f"__measured.{x}"))
    bits = [F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)) for name, condition in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return out.drop("__measured").withColumn("failed", failed.cast("long"))


def stored(ledger: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger's identifiers, measurements and bits, written and read again: what policies and ablations are applied to."""
    return staged(ledger.select(*id_cols, *MEASURES, "failed"), "rules-ledger")


def fails(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """A row per rule of the policy: rule, n_failed, n_only (that no other rule rejects), n_kept_without, n_kept."""
    masks = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(POLICIES[policy])).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, bit) for name, bit in BITS.items() if bit & POLICIES[policy]]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in rules))).alias("r")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    bit = F.col("r.bit")
    return masks.select("mask", "n", each).groupBy(F.col("r.rule").alias("rule")).agg(
        count(F.col("mask").bitwiseAND(bit) != 0).alias("n_failed"),
        count(F.col("mask") == bit).alias("n_only"),
        count((F.col("mask") == bit) | (F.col("mask") == 0)).alias("n_kept_without"),
        count(F.col("mask") == 0).alias("n_kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns."""
    bare = docs.select(F.struct(*docs.columns).alias("__row"), text_of(text_col).alias("__text"))
    return ledger(bare, "__text").filter(~fails(policy)).select("__row.*")
