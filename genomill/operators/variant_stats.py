"""Statistics of each variant, as columns beside row_idx."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions.special import chi2_tail_column
from .table import Variations


def _stat(v: Variations, column: Column, name: str) -> DataFrame:
    return v.df.select("row_idx", column.alias(name))


def calc_maf(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """Frequency of the major allele."""
    return _stat(v, g.major_frequency(F.col("calls"), min_num_genotypes), "maf")


def calc_mac(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """Count of the major allele, in samples."""
    return _stat(v, g.major_count(F.col("calls"), v.ploidy, min_num_genotypes), "mac")


def calc_allele_observation_based_maf(v: Variations) -> DataFrame:
    return _stat(v, g.depth_major_frequency(F.col("calls")), "maf")


def calc_called_gt(v: Variations, rates: bool = True, axis: int = 1) -> DataFrame:
    """Called genotypes per variant (axis 1) or per sample (axis 0), as rates or counts."""
    if axis == 0:
        rows = v.long().groupBy("sample_idx").agg(F.count_if(~g.is_missing(F.col("gt"))).alias("n"), F.count(F.lit(1)).alias("all"))
        return rows.select("sample_idx", (g.ratio(F.col("n"), F.col("all")) if rates else F.col("n")).alias("called"))
    n = g.n_called(F.col("calls"))
    return _stat(v, g.ratio(n, F.size("calls")) if rates else n, "called")


def calc_missing_gt(v: Variations, rates: bool = True, axis: int = 1) -> DataFrame:
    if axis == 0:
        rows = v.long().groupBy("sample_idx").agg(F.count_if(g.is_missing(F.col("gt"))).alias("n"), F.count(F.lit(1)).alias("all"))
        return rows.select("sample_idx", (g.ratio(F.col("n"), F.col("all")) if rates else F.col("n")).alias("missing"))
    n = F.size("calls") - g.n_called(F.col("calls"))
    return _stat(v, g.ratio(n, F.size("calls")) if rates else n, "missing")


def call_is_het(v: Variations) -> DataFrame:
    return _stat(v, F.transform("calls", lambda c: g.is_het(c["gt"])), "het")


def call_is_hom(v: Variations, low: int | None = None, high: int | None = None) -> DataFrame:
    return _stat(v, F.transform("calls", lambda c: g.is_hom(c["gt"]) & g.in_depth(c, low, high)), "hom")


def call_is_hom_ref(v: Variations) -> DataFrame:
    return _stat(v, F.transform("calls", lambda c: g.is_hom_ref(c["gt"])), "hom_ref")


def call_is_hom_alt(v: Variations) -> DataFrame:
    return _stat(v, F.transform("calls", lambda c: g.is_hom_alt(c["gt"])), "hom_alt")


def calc_obs_het(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES, min_call_dp: int = 0, max_call_dp: int | None = None) -> DataFrame:
    return _stat(v, g.observed_het(F.col("calls"), min_num_genotypes, min_call_dp, max_call_dp), "obs_het")


def calc_allele_freq(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """row_idx, allele, freq; a masked variant has no rows."""
    freqs = v.df.select("row_idx", F.explode(g.frequencies(F.col("calls"), min_num_genotypes)).alias("x"))
    return freqs.select("row_idx", "x.allele", "x.freq")


def calc_allele_freq_by_depth(v: Variations) -> DataFrame:
    sums = g.depth_sums(F.col("calls"))
    whole = F.aggregate(sums, F.lit(0).cast("long"), lambda acc, x: acc + x)
    rows = v.df.select("row_idx", F.posexplode(F.transform(sums, lambda x: g.ratio(x, whole))).alias("allele", "freq"))
    return rows


def calc_allele_counts(v: Variations) -> DataFrame:
    rows = v.df.select("row_idx", F.explode(g.allele_counts(F.col("calls"))).alias("x"))
    return rows.select("row_idx", "x.allele", "x.n")


def calc_expected_het(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    return _stat(v, g.expected_het(F.col("calls"), v.ploidy, min_num_genotypes), "exp_het")


def calc_unbias_expected_het(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    return _stat(v, g.unbiased_het(F.col("calls"), v.ploidy, min_num_genotypes), "exp_het")


def calc_unbias_expected_het2(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    return _stat(v, g.unbiased_het2(F.col("calls"), v.ploidy, min_num_genotypes), "exp_het")


def calc_inbreeding_coef(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    return _stat(v, g.inbreeding(F.col("calls"), v.ploidy, min_num_genotypes), "inbreeding")


def _gt_count(calls: Column, genotype: tuple[int, ...]) -> Column:
    want = F.array(*[F.lit(a) for a in genotype])
    return g.count_calls(calls, lambda c: ~g.is_missing(c["gt"]) & (F.array_sort(c["gt"]) == want))


def hwe(v: Variations, num_allele: int = 2, min_num_genotypes: int = g.MIN_GENOTYPES, textbook: bool = False) -> DataFrame:
    """row_idx, chi2, dof of variants with exactly ``num_allele`` alleles.

    The expected share of a genotype is, for each of its distinct orders, the frequency of its
    largest allele; ``textbook`` takes the product of all its alleles' frequencies instead.
    """
    calls = F.col("calls")
    freqs = g.frequencies(calls, min_num_genotypes)
    p = lambda a: F.coalesce(F.get(F.transform(F.filter(freqs, lambda x: x["allele"] == a), lambda x: x["freq"]), F.lit(0)), F.lit(0.0))
    rows = v.df.select("row_idx", "calls", freqs.alias("_f")).where(F.size("_f") == num_allele)
    kinds = list(combinations_with_replacement(range(num_allele), v.ploidy))
    rows = rows.select("row_idx", *[_gt_count(calls, k).alias(f"o{i}") for i, k in enumerate(kinds)], *[p(a).alias(f"p{a}") for a in range(num_allele)])
    observed = sum((F.col(f"o{i}") for i in range(1, len(kinds))), F.col("o0"))
    chi2 = F.lit(0.0)
    for i, k in enumerate(kinds):
        orders = len(set(permutations(k)))
        share = F.lit(1.0)
        if textbook:
            share = F.lit(float(orders))
            for a in k:
                share = share * F.col(f"p{a}")
        else:
            for _ in range(orders):
                share = share * F.col(f"p{k[-1]}")
        e = share * observed
        chi2 = chi2 + (F.col(f"o{i}") - e) * (F.col(f"o{i}") - e) / F.when(e != 0, e)
    return rows.select("row_idx", chi2.alias("chi2"), F.lit(len(kinds) - 1).alias("dof"))


def calc_hwe_chi2_test(v: Variations, num_allele: int = 2, min_num_genotypes: int = g.MIN_GENOTYPES, textbook: bool = False) -> DataFrame:
    """row_idx, chi2, pvalue."""
    rows = hwe(v, num_allele, min_num_genotypes, textbook)
    dof = len(list(combinations_with_replacement(range(num_allele), v.ploidy))) - 1
    p = F.exp(-F.col("chi2") / 2) if dof == 2 else chi2_tail_column(F.col("chi2"), F.lit(dof))
    return rows.select("row_idx", "chi2", p.alias("pvalue"))


def calc_maf_depth(v: Variations, min_depth: int = 10) -> DataFrame:
    """row_idx, sample_idx, maf_depth: the larger share of reference or other reads of a call, null below ``min_depth``."""
    rows = v.long()
    reads = F.filter(F.concat(F.array("ro"), F.coalesce("ao", F.array().cast("array<int>"))), lambda x: x >= 0)
    whole = F.aggregate(reads, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("row_idx", "sample_idx", F.when(whole >= max(min_depth, 1), g.ratio(F.array_max(reads), whole)).alias("maf_depth"))


def calc_depth(v: Variations) -> DataFrame:
    return v.long().select("row_idx", "sample_idx", "dp")


def calc_genotype_qual(v: Variations) -> DataFrame:
    return v.long().select("row_idx", "sample_idx", "gq")


def _flag(v: Variations, column: Column, name: str) -> DataFrame:
    return _stat(v, F.coalesce(column, F.lit(False)), name)


def is_variant(v: Variations) -> DataFrame:
    return _flag(v, F.exists(g.alleles(F.col("calls")), lambda a: a > 0), "is_variant")


def is_non_variant(v: Variations) -> DataFrame:
    return _flag(v, F.forall(g.alleles(F.col("calls")), lambda a: F.coalesce(a, F.lit(-1)) <= 0), "is_non_variant")


def count_variant(v: Variations) -> DataFrame:
    return is_variant(v).agg(F.count_if("is_variant").alias("n"))


def count_non_variant(v: Variations) -> DataFrame:
    return is_non_variant(v).agg(F.count_if("is_non_variant").alias("n"))


def is_singleton(v: Variations, allele: int = 1) -> DataFrame:
    return _flag(v, g.times(F.col("calls"), allele) == 1, "is_singleton")


def is_doubleton(v: Variations, allele: int = 1) -> DataFrame:
    return _flag(v, g.times(F.col("calls"), allele) == 2, "is_doubleton")


def count_singleton(v: Variations, allele: int = 1) -> DataFrame:
    return is_singleton(v, allele).agg(F.count_if("is_singleton").alias("n"))


def count_doubleton(v: Variations, allele: int = 1) -> DataFrame:
    return is_doubleton(v, allele).agg(F.count_if("is_doubleton").alias("n"))


def allele_number(v: Variations) -> DataFrame:
    return _stat(v, F.size(g.known_alleles(F.col("calls"))).cast("long"), "n")


def allele_count(v: Variations, allele: int = 1) -> DataFrame:
    return _stat(v, g.times(F.col("calls"), allele), "n")


def allele_frequency(v: Variations, allele: int = 1) -> DataFrame:
    whole = F.size(g.known_alleles(F.col("calls")))
    return _stat(v, F.coalesce(g.ratio(g.times(F.col("calls"), allele), whole), F.lit(0.0)), "freq")


def row_value_counter(v: Variations, value: int, ratio: bool = False) -> DataFrame:
    """How often an allele number occurs in each variant, as a count or as a share of all alleles, missing ones too."""
    n = g.times(F.col("calls"), value)
    return _stat(v, g.ratio(n, F.size(g.alleles(F.col("calls")))) if ratio else n, "n")


def tajima(v: Variations, min_num_genotypes: int = g.MIN_GENOTYPES, min_num_segregating_variations: int = 10, haplotype: int | None = None, seed: int = 0, indexes: list[int] | None = None) -> DataFrame:
    """One row: seg_sites, theta, pi, d, theta_per_site, pi_per_site; d and the rest null below the wanted segregating sites.

    One haplotype of each sample: that of number ``haplotype``, or one drawn for each sample by ``seed``, the same for all variants.
    """
    import random

    places = list(range(len(v.samples))) if indexes is None else indexes
    draw = random.Random(seed)
    chosen = {i: draw.randrange(v.ploidy) if haplotype is None else haplotype for i in places}
    calls = F.col("calls")
    haps = F.filter(F.array(*[F.get(F.get(calls, F.lit(i))["gt"], F.lit(h)) for i, h in chosen.items()]), lambda a: a.isNotNull())
    counts = g.counts_of(haps)
    n = g.total(counts)
    upto = F.when(n > 1, F.sequence(F.lit(1), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = v.df.select("row_idx", g.n_called(g.pick(calls, indexes)).alias("m"), n.alias("n"), F.size(counts).alias("k"), (1 - F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + F.pow(g.ratio(c["n"], n), F.lit(float(v.ploidy))))).alias("h"), F.when(n > 0, F.aggregate(upto, F.lit(0.0), lambda acc, i: acc + 1.0 / i)).alias("a1"), F.when(n > 0, F.aggregate(upto, F.lit(0.0), lambda acc, i: acc + 1.0 / (i * i))).alias("a2"))
    rows = rows.agg(
        F.count_if(F.col("k") > 1).alias("s"), F.avg("a1").alias("a1"), F.avg("a2").alias("a2"), F.avg("n").alias("n"), F.count(F.lit(1)).alias("v"),
        F.sum(F.when(F.col("n") > 1, F.col("n") / F.when(F.col("n") > 1, F.col("n") - 1) * F.col("h"))).alias("pi"), F.count_if(F.col("m") >= min_num_genotypes).alias("enough"),
    )
    s, a1, a2, n = (F.col(x) for x in ("s", "a1", "a2", "n"))
    ok = (s >= min_num_segregating_variations) & (F.col("enough") > 0) & (n > 1) & (a1 > 0)
    one = F.when(ok, F.lit(1.0))
    b1 = (n + 1) / (3 * (F.when(ok, n) - 1))
    b2 = 2 * (n * n + n + 3) / (9 * F.when(ok, n) * (F.when(ok, n) - 1))
    a = F.when(ok, a1)
    e1 = (b1 - one / a) / a
    e2 = (b2 - (n + 2) / (a * n) + a2 / (a * a)) / (a * a + a2)
    theta = s / a
    d = (F.col("pi") - theta) / F.sqrt(e1 * s + e2 * s * (s - 1))
    return rows.select(s.alias("seg_sites"), theta.alias("theta"), (F.col("pi") * one).alias("pi"), d.alias("d"), (theta / F.col("v")).alias("theta_per_site"), (F.col("pi") * one / F.col("v")).alias("pi_per_site"))


def a1(n: int) -> float:
    return math.fsum(1 / i for i in range(1, n))
