"""Ordination: samples x samples matrices are summed in Spark, and small ones solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions.special import bound
from .table import Variations


def _gram(rows: DataFrame, n: int) -> np.ndarray:
    """X'X of rows with an array column x of n numbers: products are summed by pair of samples; n is bounded by the samples of a table."""
    pairs = rows.select(F.posexplode("x").alias("i", "a"), "x").select("i", "a", F.posexplode("x").alias("j", "b")).where("i <= j")
    out = np.zeros((n, n))
    for i, j, s in pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b"))).collect():
        out[i, j] = out[j, i] = s
    return out


def gram_matrix(v: Variations) -> DataFrame:
    """i, j, s: sums over variants of the products of centred dosages times the samples squared, in whole numbers; missing counts as -1."""
    dose = F.transform(g.dosages(F.col("calls")), lambda d: F.coalesce(d, F.lit(-1)).cast("long"))
    n = len(v.samples)
    total = lambda d: F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + x)
    centred = bound({"d": dose}, lambda s: bound({"t": total(s["d"])}, lambda u: F.transform(s["d"], lambda x: x * n - u["t"])))
    rows = v.df.select(centred.alias("x"))
    pairs = rows.select(F.posexplode("x").alias("i", "a"), "x").select("i", "a", F.posexplode("x").alias("j", "b")).where("i <= j")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))


def _ordered(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)[::-1]
    return values[order], vectors[:, order]


def do_pca(v: Variations) -> dict:
    """projections (samples x components), var_percentages of the centred dosages of all variants; missing counts as -1."""
    n = len(v.samples)
    if v.num_variations() < n:
        raise ValueError("fewer variants than samples")
    gram = np.zeros((n, n))
    for i, j, s in gram_matrix(v).collect():
        gram[i, j] = gram[j, i] = s / n**2
    values, vectors = _ordered(*np.linalg.eigh(gram))
    values = np.maximum(values, 0)
    return {"projections": vectors * np.sqrt(values), "var_percentages": values / values.sum() * 100 if values.sum() else values}


def do_pcax(v: Variations, n_components: int = 10) -> dict:
    """Of biallelic variants, each dosage centred and divided by sqrt(p (1 - p)); missing genotypes count as the mean."""
    calls = F.col("calls")
    dose = g.dosages(calls)
    known = F.filter(dose, lambda d: d.isNotNull())
    mean = g.ratio(F.aggregate(known, F.lit(0).cast("long"), lambda a, d: a + d), F.size(known))
    rows = v.df.where(F.size(g.allele_counts(calls)) == 2).select(dose.alias("d"), mean.alias("m")).where("m > 0")
    p = F.col("m") / v.ploidy
    x = F.transform("d", lambda d: F.coalesce((d - F.col("m")) / F.sqrt(p * (1 - p)), F.lit(0.0)))
    gram = _gram(rows.where(p < 1).select(x.alias("x")), len(v.samples))
    values, vectors = _ordered(*np.linalg.eigh(gram))
    values = np.maximum(values, 0)
    return {"projections": (vectors * np.sqrt(values))[:, :n_components], "var_percentages": (values / values.sum() * 100)[:n_components]}


def matrix_of(dists: DataFrame, n: int) -> np.ndarray:
    """A square matrix from (i, j, dist); n samples bound it."""
    out = np.zeros((n, n))
    for i, j, d in dists.select("i", "j", "dist").collect():
        out[i, j] = out[j, i] = np.nan if d is None else d
    return out


def do_pcoa(square: np.ndarray) -> dict:
    """Principal coordinates: double-centred squared distances, sorted by eigenvalue; shares may be negative."""
    if np.isnan(square).any():
        raise ValueError("missing distances")
    e = -(square**2) / 2
    f = e - e.mean(axis=0) - e.mean(axis=1)[:, None] + e.mean()
    values, vectors = _ordered(*np.linalg.eigh(f))
    return {"projections": vectors * np.sqrt(np.abs(values)), "var_percentages": values / values.sum() * 100}


def non_param_multi_dim_scaling(square: np.ndarray, n_dims: int = 3, metric: bool = True, rounds: int = 300, tolerance: float = 1e-6, seed: int = 0) -> dict:
    """Stress majorisation from a random start; without ``metric`` distances count by their ranks."""
    n = len(square)
    target = np.array(square, dtype=float)
    x = np.random.default_rng(seed).random((n, n_dims))
    upper = np.triu_indices(n, 1)
    before = np.inf
    for _ in range(rounds):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        goal = target
        if not metric:
            order = np.argsort(target[upper], kind="stable")
            level = _isotonic(d[upper][order])
            flat = np.empty_like(level)
            flat[order] = level
            flat *= np.sqrt(len(flat) / max((flat**2).sum(), 1e-12))
            goal = np.zeros((n, n))
            goal[upper] = flat
            goal += goal.T
        stress = ((d - goal)[upper] ** 2).sum()
        if before - stress < tolerance * max(before, 1) and np.isfinite(before):
            break
        before = stress
        b = -np.divide(goal, d, out=np.zeros_like(d), where=d > 0)
        b[np.arange(n), np.arange(n)] = -b.sum(axis=1)
        x = b @ x / n
    return {"projections": x, "stress": float(stress)}


def _isotonic(y: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to y."""
    blocks: list[list[float]] = []
    for value in y:
        blocks.append([float(value), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    return np.concatenate([np.full(int(k), m) for m, k in blocks])


def isomap(v: Variations, n_components: int = 3, neighbours: int = 5) -> np.ndarray:
    """Coordinates of shortest paths over the nearest samples by dosage."""
    n = len(v.samples)
    dose = F.transform(g.dosages(F.col("calls")), lambda d: F.coalesce(d, F.lit(-1)).cast("long"))
    gram = _gram(v.df.select(dose.alias("x")), n)
    own = np.diag(gram)
    d = np.sqrt(np.maximum(own[:, None] + own[None] - 2 * gram, 0))
    path = np.full((n, n), np.inf)
    for i in range(n):
        near = np.argsort(d[i])[: neighbours + 1]
        path[i, near] = d[i, near]
    path = np.minimum(path, path.T)
    for k in range(n):
        path = np.minimum(path, path[:, k : k + 1] + path[k : k + 1])
    path[np.isinf(path)] = path[np.isfinite(path)].max()
    return do_pcoa(path)["projections"][:, :n_components]
