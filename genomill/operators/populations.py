"""Statistics of populations. Each is a row expression over the population's calls, so nothing shuffles before a summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from .table import Variations
from .variant_stats import tajima

MIN_DP_FOR_HET = 20


def members(v: Variations, populations: dict | None = None) -> dict[str, list[int]]:
    pops = v.populations if populations is None else populations
    if not pops:
        raise ValueError("no populations")
    return {str(p): v.indexes(list(names)) for p, names in pops.items()}


def per_population(v: Variations, stat: Callable[[Column], Column], name: str, populations: dict | None = None) -> DataFrame:
    """row_idx, pop, and the statistic of the population's calls."""
    rows = [F.struct(F.lit(p).alias("pop"), stat(g.pick(F.col("calls"), idx)).alias(name)) for p, idx in members(v, populations).items()]
    return v.df.select("row_idx", F.explode(F.array(*rows)).alias("s")).select("row_idx", "s.pop", f"s.{name}")


def calc_number_of_alleles(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """n_alleles; 0 below the wanted genotypes."""
    return per_population(v, lambda c: F.when(g.n_called(c) >= min_num_genotypes, F.size(g.allele_counts(c))).otherwise(0).cast("long"), "n_alleles", populations)


def calc_number_of_alleles_and_number_called_gts(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    n = lambda c: F.struct(F.when(g.n_called(c) >= min_num_genotypes, F.size(g.allele_counts(c))).otherwise(0).cast("long").alias("a"), g.n_called(c).alias("b"))
    return per_population(v, n, "x", populations).select("row_idx", "pop", F.col("x.a").alias("n_alleles"), F.col("x.b").alias("n_called"))


def calc_number_of_private_alleles(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """Alleles of a population that no other has; 0 where the population or all samples outside it have too few genotypes."""
    pops = members(v, populations)
    if len(pops) < 2:
        raise ValueError("at least two populations are needed")
    calls = F.col("calls")
    have = {p: F.array_distinct(g.known_alleles(g.pick(calls, idx))) for p, idx in pops.items()}
    rows = []
    for p, idx in pops.items():
        others = F.array_distinct(F.flatten(F.array(*[a for q, a in have.items() if q != p])))
        n = F.size(F.array_except(have[p], others)).cast("long")
        if min_num_genotypes:
            own = g.n_called(g.pick(calls, idx))
            n = F.when((own >= min_num_genotypes) & (g.n_called(calls) - own >= min_num_genotypes), n).otherwise(0)
        rows.append(F.struct(F.lit(p).alias("pop"), n.cast("long").alias("n")))
    return v.df.select("row_idx", F.explode(F.array(*rows)).alias("s")).select("row_idx", "s.pop", F.col("s.n").alias("n_private"))


def calc_major_allele_freq(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    return per_population(v, lambda c: g.major_frequency(c, min_num_genotypes), "maf", populations)


def calc_obs_het(v: Variations, populations: dict | None = None, min_call_dp: int = MIN_DP_FOR_HET, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    return per_population(v, lambda c: g.observed_het(c, min_num_genotypes, min_call_dp), "obs_het", populations)


def calc_exp_het(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """Unbiased."""
    return per_population(v, lambda c: g.unbiased_het(c, v.ploidy, min_num_genotypes), "exp_het", populations)


def calc_tajima_d_and_pi_for_pops(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES, min_num_segregating_variations: int = 10, haplotype: int | None = None, seed: int = 0) -> DataFrame:
    """pop and what ``tajima`` gives; populations with too few segregating sites are left out."""
    out = None
    for p, idx in members(v, populations).items():
        one = tajima(v, min_num_genotypes, min_num_segregating_variations, haplotype, seed, idx).withColumn("pop", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out.where("theta is not null")


STATS = {"n_alleles": calc_number_of_alleles, "n_private": calc_number_of_private_alleles, "maf": calc_major_allele_freq, "obs_het": calc_obs_het, "exp_het": calc_exp_het}


def calc_pop_stats(v: Variations, stats: list, populations: dict | None = None, **options) -> DataFrame:
    """row_idx, pop, and a column for each statistic, by name or as a function of (v, populations)."""
    out = None
    for s in stats:
        one = (STATS[s] if isinstance(s, str) else s)(v, populations, **options)
        out = one if out is None else out.join(one, ["row_idx", "pop"])
    return out


def pop_stats_report(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES, min_call_dp: int = MIN_DP_FOR_HET) -> DataFrame:
    """stat, pop, mean, min, q25, median, q75, max, and for maf the shares that are almost fixed (at least 0.95) and highly variable (below 0.7)."""
    stats = {
        "n_alleles": calc_number_of_alleles(v, populations, min_num_genotypes), "n_private": calc_number_of_private_alleles(v, populations, min_num_genotypes), "maf": calc_major_allele_freq(v, populations, min_num_genotypes),
        "obs_het": calc_obs_het(v, populations, min_call_dp, min_num_genotypes), "exp_het": calc_exp_het(v, populations, min_num_genotypes),
    }
    out = None
    for name, rows in stats.items():
        x = F.col(name).cast("double")
        quantiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        one = rows.groupBy("pop").agg(F.avg(x).alias("mean"), F.min(x).alias("min"), quantiles.alias("q"), F.max(x).alias("max"), F.count(x).alias("n"), F.count_if(x >= 0.95).alias("fixed"), F.count_if(x < 0.7).alias("loose"))
        share = lambda c, name=name: F.when(F.lit(name == "maf"), 100 * g.ratio(F.col(c), F.col("n")))
        one = one.select(F.lit(name).alias("stat"), "pop", "mean", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max", share("fixed").alias("almost_fixed"), share("loose").alias("highly_variable"))
        out = one if out is None else out.unionByName(one)
    return out
