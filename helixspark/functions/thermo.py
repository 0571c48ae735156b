"""Melting temperatures and oligo checks as Columns. Concentrations in mol/l; temperatures in degrees Celsius."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dna, tables


@dataclass(frozen=True)
class Params:
    """Defaults of the design parameters."""

    tm_penalty: float = 1.0
    tm_max_difference: float = 5.0
    position_penalty: float = 5.0
    length_penalty: float = 3.0
    poly_length: int = 4
    poly_penalty: float = 10.0
    unstable_penalty: float = 5.0
    at_penalty: float = 3.0
    target_length: int = 20
    max_length: int = 60
    min_length: int = 20
    monovalent: float = 0.05
    primer: float = 0.25e-6
    divalent: float = 1.5e-3
    template: float = 0.01e-6
    dntp: float = 0.0
    compat: bool = False

    @property
    def kelvin(self) -> float:
        return tables.KELVIN_COMPAT if self.compat else tables.KELVIN


def pair_sum(s: Column | str, table: dict[str, float]) -> Column:
    """Sum of a table's values over all neighbouring bases."""
    s = dna._c(s)
    values = dna.literal_map(table)
    return F.aggregate(F.transform(dna.positions(F.length(s) - 2), lambda i: F.element_at(values, dna.substr(s, i, 2))), F.lit(0.0), lambda a, x: a + x)


#: Sums over neighbours are kept as whole numbers of so small parts, so that differences of them are exact.
_PARTS = 100_000


def neighbour_sums(s: Column | str) -> Column:
    """h, e, gc, unknown: sums over all neighbouring bases before each base, so that those of a window are differences."""
    s = dna._c(s)
    h, e = (dna.literal_map({k: round(v * _PARTS) for k, v in t.items()}) for t in (tables.NN_H, tables.NN_S))
    none = F.lit(0).cast("long")

    def step(a, x):
        last, value = F.element_at(a, F.lit(-1)), {"h": F.element_at(h, x), "e": F.element_at(e, x), "gc": x.substr(1, 1).isin("G", "C").cast("long"), "unknown": F.element_at(h, x).isNull().cast("long")}
        return F.array_append(a, F.struct(*((last[k] + F.coalesce(v.cast("long"), none)).alias(k) for k, v in value.items())))

    pairs = F.transform(dna.positions(F.length(s) - 2), lambda i: dna.substr(s, i, 2))
    return F.aggregate(pairs, F.array(F.struct(*(none.alias(k) for k in ("h", "e", "gc", "unknown")))), step)


def sums_within(sums: Column, start: Column, n: Column) -> Column:
    """neighbour_sums of the n bases from the 0-based start."""
    a, b = F.get(sums, start), F.get(sums, start + n - 1)
    return F.struct(*((b[k] - a[k]).alias(k) for k in ("h", "e", "gc", "unknown")))


def end_terms(s: Column | str, table: dict[str, float]) -> Column:
    s, values = dna._c(s), dna.literal_map(table)
    return F.element_at(values, F.substring(s, 1, 1)) + F.element_at(values, F.substring(s, -1, 1))


def strand_concentration(a: float, b: float) -> float:
    return a / 4 if abs(a - b) / (a + b) < 0.1 else max(a, b) - min(a, b) / 2


def tm_1m(s: Column | str, p: Params = Params(), sums: Column | None = None) -> Column:
    """Kelvin at 1 mol/l of sodium, by nearest neighbours. At least three bases. sums: those of s by sums_within(), if known."""
    s = dna._c(s)
    own = dna.self_complementary(s)
    known = lambda k, table: pair_sum(s, table) if sums is None else F.when(sums["unknown"] == 0, sums[k] / _PARTS)
    h = end_terms(s, tables.END_H) + known("h", tables.NN_H)
    e = end_terms(s, tables.END_S) + known("e", tables.NN_S)
    ct = F.when(own, p.primer).otherwise(strand_concentration(p.primer, p.template))
    return 1000 * h / (e + F.when(own, -1.4).otherwise(0.0) + tables.GAS * F.ln(ct))


def salt_regime(p: Params) -> tuple[int, float]:
    """1 and 4: divalent, 2: monovalent, 3: mixed; and the ratio that decides."""
    if p.monovalent < 1e-8:
        return 1, 999.0
    r = p.divalent**0.5 / p.monovalent
    return (2 if r < 0.22 else 3 if r < 6 else 4), r


def melting(s: Column | str, p: Params = Params(), sums: Column | None = None) -> Column:
    """Melting temperature of the whole oligo. sums: its sums_within(), if known."""
    import math

    s = dna._c(s)
    regime, _ = salt_regime(p)
    reciprocal, gc = 1 / tm_1m(s, p, sums), dna.gc(s) if sums is None else (sums["gc"] + F.right(s, F.lit(1)).isin("G", "C").cast("long")) / F.length(s)
    t = dict(tables.SALT)
    if regime == 2:
        ln = math.log(p.monovalent)
        fixed = reciprocal + (4.29 * gc - 3.95) * 1e-5 * ln + 9.40e-6 * ln * ln
    else:
        ln = math.log(max(0.0, p.divalent - p.dntp))
        if regime == 3:
            m = math.log(p.monovalent)
            t["a"] *= 0.843 - 0.352 * p.monovalent**0.5 * m
            t["d"] *= 1.279 - 4.03e-3 * m - 8.03e-3 * m * m
            t["g"] *= 0.486 - 0.258 * m + 5.25e-3 * m**3
        tail = t["e"] + t["f"] * ln + t["g"] * ln * ln
        fixed = reciprocal + t["a"] + t["b"] * ln + gc * (t["c"] + t["d"] * ln) + tail / (2.0 * (F.length(s) - 1))
    return 1 / fixed - p.kelvin


def rule_of_thumb(gc: Column, n: Column, compat: bool = False) -> Column:
    """Whole degrees from the number of G and C and the length."""
    short = 4 * gc + 2 * (n - gc) * (2 if compat else 1)
    return F.when(n < 14, short).otherwise((64.9 + 41.0 * (gc - 16.4) / n).cast("int"))


def end_energy(s: Column | str) -> Column:
    """Free energy of the last five bases with the term of the last one."""
    s = dna._c(s)
    return pair_sum(F.right(s, F.lit(5)), tables.DELTA_G_END) + F.element_at(dna.literal_map(tables.INIT_G_END), F.right(s, F.lit(1)))


def three_prime_stable(s: Column | str) -> Column:
    s = dna._c(s)
    return dna.require(F.length(s) >= 6, end_energy(s) > -9.0, "oligo too short for its 3' stability")


# -- units


def celsius(kelvin: Column | str, p: Params = Params()) -> Column:
    return dna._c(kelvin) - p.kelvin


def kelvin(celsius: Column | str, p: Params = Params()) -> Column:
    return dna._c(celsius) + p.kelvin


#: Units of concentration, in moles a litre.
MOLAR = {"mM": 1e3, "uM": 1e6, "nM": 1e9}


def molar(x: Column | str, unit: str) -> Column:
    return dna._c(x) / MOLAR[unit]
