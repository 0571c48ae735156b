"""Numbers: combinatorics, distributions and descriptive statistics as Columns; special functions as Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dna import _c, positions


def mean(x: Column | str) -> Column:
    return F.avg(_c(x))


def mean_square(x: Column | str) -> Column:
    return F.avg(_c(x) * _c(x))


def describe(x: Column | str) -> list[Column]:
    """mean, ssq (the mean square), var and sd of a population, median."""
    x = _c(x)
    return [F.avg(x).alias("mean"), mean_square(x).alias("ssq"), F.var_pop(x).alias("var"), F.stddev_pop(x).alias("sd"), F.median(x).alias("median")]


def product(last: Column | int, term, start: float = 1.0) -> Column:
    """Product of term(i) for i from 1 to last."""
    last = F.lit(last).cast("int")
    return F.aggregate(F.transform(positions(last - 1), lambda i: (i + 1).cast("double")), F.lit(start), lambda acc, i: acc * term(i))


def fact(n: Column | int) -> Column:
    return product(n, lambda i: i)


def ncr(n: Column | str, k: Column | str) -> Column:
    """Binomial coefficient as double; 0 for k > n."""
    n, k = _c(n).cast("double"), _c(k)
    return F.when(k > n, 0.0).otherwise(product(k, lambda i: (n - k + i) / i))


def hypergeo(total: Column, draws: Column, k: Column, white: Column) -> Column:
    """Chance of k white among draws from total with so many white."""
    impossible = (k > draws) | (k > white) | (draws - k > total - white)
    return F.when(impossible, 0.0).otherwise(ncr(white, k) * ncr(total - white, draws - k) / ncr(total, draws))


def binomial(n: Column, k: Column, p: Column) -> Column:
    return ncr(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)


def binomial_cum(n: Column, k: Column, p: Column) -> Column:
    return F.aggregate(F.transform(positions(F.least(k, n)), lambda i: binomial(n, i, p)), F.lit(0.0), lambda a, x: a + x)


def hypergeo_cum(total: Column, draws: Column, k: Column, white: Column) -> Column:
    return F.aggregate(F.transform(positions(k), lambda i: hypergeo(total, draws, i, white)), F.lit(0.0), lambda a, x: a + x)


def gcd(a: Column | str, b: Column | str) -> Column:
    """Euclid's algorithm; 64-bit numbers take fewer than 93 steps."""
    pair = F.struct(F.abs(_c(a).cast("long")).alias("x"), F.abs(_c(b).cast("long")).alias("y"))
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % F.when(p["y"] == 0, 1).otherwise(p["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), pair, step, lambda p: p["x"])


def poisson(rate: Column, k: Column) -> Column:
    """Probability of k."""
    return F.pow(rate, k) * F.exp(-rate) / fact(k)


def merge_primes(a: Column | str, b: Column | str, sign: int = 1) -> Column:
    """Exponents by prime of a product (sign 1) or a quotient (-1)."""
    return F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.coalesce(x, F.lit(0)) + sign * F.coalesce(y, F.lit(0)))


def expand_primes(m: Column | str) -> Column:
    return F.aggregate(F.map_entries(_c(m)), F.lit(0.0), lambda acc, e: acc + e["value"] * F.ln(e["key"]), lambda x: F.exp(x))


# -- random variates


def normal(mu: float = 0.0, sd: float = 1.0, seed: int = 0) -> Column:
    return F.randn(seed) * sd + mu


def exponential(mu: float = 1.0, seed: int = 0) -> Column:
    return -mu * F.ln(1 - F.rand(seed))


def weibull(scale: float, shape: float, seed: int = 0) -> Column:
    return scale * F.pow(-F.ln(1 - F.rand(seed)), F.lit(1 / shape))


def _variates(draw, seed: int) -> Column:
    @F.pandas_udf("double")
    def f(key: pd.Series) -> pd.Series:
        # A generator for each row, so that a task that runs again draws the same.
        return pd.Series([draw(np.random.default_rng([seed, int(k) & (2**63 - 1)])) for k in key])

    return f


def gamma_variate(key: Column | str, shape: float, scale: float = 1.0, seed: int = 0) -> Column:
    return _variates(lambda g: g.gamma(shape, scale), seed)(_c(key).cast("long"))


def beta_variate(key: Column | str, a: float, b: float, seed: int = 0) -> Column:
    return _variates(lambda g: g.beta(a, b), seed)(_c(key).cast("long"))


# -- special functions


def _lower_gamma(s: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    # Continued fraction of the upper one, by Lentz.
    b = x + 1 - s
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def _ibeta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _ibeta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _student(t: float, dof: float) -> float:
    half = _ibeta(dof / 2, 0.5, dof / (dof + t * t)) / 2
    return 1 - half if t > 0 else half


def _arrow(f):
    def column(*args: Column | str | float) -> Column:
        @F.pandas_udf("double")
        def g(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

        return g(*((F.lit(a) if isinstance(a, (int, float)) else _c(a)).cast("double") for a in args))

    return column


gamma = _arrow(math.gamma)
log_gamma = _arrow(math.lgamma)
lower_gamma = _arrow(lambda s, x: _lower_gamma(s, x) * math.gamma(s))
upper_gamma = _arrow(lambda s, x: (1 - _lower_gamma(s, x)) * math.gamma(s))
beta = _arrow(lambda a, b: math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
ibeta = _arrow(_ibeta)
pbeta = _arrow(lambda x, a, b: _ibeta(a, b, x))
student_cdf = _arrow(_student)


# -- tests and corrections


def t_test(df: DataFrame, group: str, value: str, a, b, pooled: bool = False) -> DataFrame:
    """t, dof and p (lower tail) of two groups' means: one pass over the rows, population variances. Welch's unless pooled."""
    part = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = df.filter(F.col(group).isin(a, b)).agg(
        part(a, F.count).alias("n1"), part(b, F.count).alias("n2"), part(a, F.avg).alias("m1"), part(b, F.avg).alias("m2"), part(a, F.var_pop).alias("v1"), part(b, F.var_pop).alias("v2")
    )
    n1, n2, v1, v2 = (F.col(x) for x in ("n1", "n2", "v1", "v2"))
    if pooled:
        se = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * F.sqrt(1 / n1 + 1 / n2)
        dof = (n1 + n2 - 2).cast("double")
    else:
        se = F.sqrt(v1 / n1 + v2 / n2)
        dof = F.pow(v1 / n1 + v2 / n2, F.lit(2)) / (F.pow(v1 / n1, F.lit(2)) / (n1 - 1) + F.pow(v2 / n2, F.lit(2)) / (n2 - 1))
    return s.select(((F.col("m1") - F.col("m2")) / se).alias("t"), dof.alias("dof")).withColumn("p", student_cdf("t", "dof"))


def _counted(df: DataFrame, p: str) -> tuple[DataFrame, Window, int]:
    """Distinct p-values with their counts: ties share a rank, and what is ranked is pre-aggregated."""
    counts = df.groupBy(p).agg(F.count(F.lit(1)).alias("__n"))
    up = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("__upto", F.sum("__n").over(up)), up, df.count()


def q_values(df: DataFrame, p: str = "p", level: float = 0.5) -> DataFrame:
    """df with q, Storey's step-up: the share of true nulls from the p-values above the level."""
    counts, _, m = _counted(df, p)
    share = df.filter(F.col(p) > level).count() / (m * (1 - level)) if m else 1.0
    down = Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * min(1.0, share) * m / F.col("__upto")).over(down))
    return df.join(counts.select(p, q.alias("q")), p)


def holm(df: DataFrame, p: str = "p", rate: float = 0.05) -> DataFrame:
    """Rows that are significant by Holm's step-down procedure."""
    counts, up, m = _counted(df, p)
    # All of the tied values must pass; the last of them faces the mildest bound, the first the strictest.
    passes = F.min((F.col(p) <= rate / (m - (F.col("__upto") - F.col("__n")))).cast("int")).over(up)
    return df.join(counts.withColumn("__ok", passes).filter("__ok = 1").select(p), p, "left_semi")


def primes(spark, limit: int) -> DataFrame:
    """Primes below limit: numbers without a divisor up to their root."""
    n = spark.range(2, max(limit, 2)).withColumnRenamed("id", "p")
    small = spark.range(2, math.isqrt(max(limit, 4)) + 1).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.greatest(F.lit(limit).cast("long"), F.col("id") * F.col("id")), F.col("id"))).alias("p"))
    return n.join(small.distinct(), "p", "left_anti")


def factorial_primes(numbers: DataFrame, n: str = "n", limit: int = 200) -> DataFrame:
    """n, p, e: exponents of the primes in n!, by Legendre. limit: bound of n."""
    ps = primes(numbers.sparkSession, limit + 1)
    powers = F.sequence(F.lit(1), F.floor(F.ln(F.lit(limit + 0.5)) / F.ln("p")).cast("int"))
    e = F.aggregate(F.transform(powers, lambda j: F.floor(F.col(n) / F.pow("p", j))), F.lit(0).cast("long"), lambda a, x: a + x)
    return numbers.join(F.broadcast(ps), F.col("p") <= F.col(n)).select(n, "p", e.alias("e"))  # limit rows at most
