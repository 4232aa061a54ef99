"""Tails of distributions in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(x: float | None, freedom: int) -> float | None:
    """P(X > x) of the chi-squared distribution with a whole number of degrees of freedom."""
    if x is None or freedom < 1 or math.isnan(x):
        return None
    if math.isinf(x):
        return 0.0
    half = x / 2
    if freedom % 2 == 0:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= half / i
            total += term
        return min(1.0, math.exp(-half) * total)
    total, term = 0.0, math.sqrt(2 * x / math.pi)
    for i in range(1, freedom - 1, 2):
        total += term
        term *= x / (i + 2)
    return min(1.0, math.erfc(math.sqrt(half)) + math.exp(-half) * total)


# A Chebyshev fit of erfc, good to 1.2e-7 of the value.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc_column(z: Column) -> Column:
    """The complementary error function of a number that isn't negative."""
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(-z * z + poly)


def bound(values: dict[str, Column], body) -> Column:
    """body of the named values, each of which is worked out once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def chi2_tail_column(x: Column, freedom: Column) -> Column:
    """P(X > x) as an expression: exact for even degrees of freedom, to 1e-7 for odd ones; null below one degree."""
    return bound({"x": x, "k": freedom}, lambda s: _tail(s["x"], s["k"]))


def _tail(x: Column, freedom: Column) -> Column:
    half = x / 2
    steps = F.sequence(F.lit(1), F.greatest(freedom, F.lit(1)).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    more = lambda acc, i: F.struct((acc["term"] * half / i).alias("term"), (acc["total"] + acc["term"] * half / i).alias("total"))
    even = F.exp(-half) * F.aggregate(F.filter(steps, lambda i: 2 * i < freedom), start, more)["total"]
    begin = F.struct(F.sqrt(2 * x / math.pi).alias("term"), F.lit(0.0).alias("total"))
    next_ = lambda acc, i: F.struct((acc["term"] * x / (2 * i + 1)).alias("term"), (acc["total"] + acc["term"]).alias("total"))
    odd = erfc_column(F.sqrt(half)) + F.exp(-half) * F.aggregate(F.filter(steps, lambda i: 2 * i < freedom), begin, next_)["total"]
    return F.when(freedom >= 1, F.least(F.lit(1.0), F.when(freedom % 2 == 0, even).otherwise(odd)))


def contingency_column(one: Column, two: Column) -> Column:
    """p of two arrays of (key, n) being of one distribution; corrected for one degree of freedom, 1 for none, null if a side is empty."""
    total = lambda side: F.aggregate(side, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    keys = lambda side: F.transform(side, lambda c: c["gt"])
    sides = lambda s: {"one": s["one"], "two": s["two"], "r1": total(s["one"]), "r2": total(s["two"]), "kinds": F.array_union(keys(s["one"]), keys(s["two"]))}
    # Each step is bound once: the tail's series would evaluate the statistic again for every term.
    return bound({"one": one, "two": two}, lambda s: bound(sides(s), lambda t: bound({"x": _statistic(t), "r1": t["r1"], "r2": t["r2"], "freedom": F.size(t["kinds"]) - 1}, _chance)))


def _statistic(s) -> Column:
    whole = (s["r1"] + s["r2"]).cast("double")
    of = lambda side, k: F.aggregate(F.filter(side, lambda c: c["gt"] == k), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])

    def part(n, row, col):
        e = row * col / F.when(whole > 0, whole)
        d = F.abs(n - e)
        d = F.when(F.size(s["kinds"]) == 2, d - F.least(F.lit(0.5), d)).otherwise(d)
        return d * d / F.when(e > 0, e)

    counts = F.transform(s["kinds"], lambda k: F.struct(of(s["one"], k).alias("n"), of(s["two"], k).alias("m")))
    return F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + part(c["n"], s["r1"], c["n"] + c["m"]) + part(c["m"], s["r2"], c["n"] + c["m"]))


def _chance(s) -> Column:
    return F.when((s["r1"] > 0) & (s["r2"] > 0), F.when(s["freedom"] == 0, 1.0).otherwise(chi2_tail_column(s["x"], s["freedom"])))


def poisson_quantile(mean: float, share: float) -> int:
    """The smallest k with P(X <= k) >= share."""
    term = total = math.exp(-mean)
    k = 0
    while total < share and k < 10 * mean + 1000:
        k += 1
        term *= mean / k
        total += term
    return k


def yates(a: float, b: float) -> float:
    """p of two counts being halves of their sum, with the continuity correction."""
    e = (a + b) / 2
    return chi2_tail(sum((abs(x - e) - 0.5) ** 2 / e for x in (a, b)), 1) if e else 1.0


def contingency(table: list[list[float]]) -> float | None:
    """p of independence of rows and columns; corrected for one degree of freedom, 1 for none, None if a margin is empty."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    whole = sum(rows)
    if not whole or 0 in rows or 0 in cols:
        return None
    freedom = (len(rows) - 1) * (len(cols) - 1)
    if not freedom:
        return 1.0
    x = 0.0
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            e = r * c / whole
            d = abs(table[i][j] - e)
            x += (d - min(0.5, d) * (freedom == 1)) ** 2 / e
    return chi2_tail(x, freedom)
