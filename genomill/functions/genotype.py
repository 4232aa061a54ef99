"""Column expressions over the calls of a variant: ``calls`` is an array of structs with ``gt``, an array of allele numbers.

A missing allele is null. A call is missing if any of its alleles is; allele counts still use the
alleles that a partial call has. Everything here stays inside one row, so no plan shuffles for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import bound

MIN_GENOTYPES = 10


def pick(calls: Column, indexes: list[int] | None) -> Column:
    """The calls of some samples, in the given order; all of them for None."""
    if indexes is None:
        return calls
    return bound({"c": calls}, lambda s: F.transform(F.array(*[F.lit(i) for i in indexes]), lambda i: F.get(s["c"], i)))


def is_missing(gt: Column) -> Column:
    return F.coalesce(F.exists(gt, lambda a: a.isNull()) | (F.size(gt) == 0), F.lit(True))


def is_het(gt: Column) -> Column:
    return ~is_missing(gt) & F.coalesce(F.exists(gt, lambda a: a != gt[0]), F.lit(False))


def is_hom(gt: Column) -> Column:
    return ~is_missing(gt) & ~F.coalesce(F.exists(gt, lambda a: a != gt[0]), F.lit(False))


def is_hom_ref(gt: Column) -> Column:
    return is_hom(gt) & F.coalesce(gt[0] == 0, F.lit(False))


def is_hom_alt(gt: Column) -> Column:
    return is_hom(gt) & F.coalesce(gt[0] != 0, F.lit(False))


def in_depth(call: Column, low: int | None = None, high: int | None = None) -> Column:
    """Whether a call is inside the depth bounds; an unknown depth counts as -1."""
    ok = F.lit(True)
    dp = F.coalesce(call["dp"], F.lit(-1)) if low or high is not None else None
    if low:
        ok = ok & (dp >= low)
    if high is not None:
        ok = ok & (dp <= high)
    return ok


def count_calls(calls: Column, test) -> Column:
    return F.size(F.filter(calls, test)).cast("long")


def n_called(calls: Column, low: int | None = None, high: int | None = None) -> Column:
    return count_calls(calls, lambda c: ~is_missing(c["gt"]) & in_depth(c, low, high))


def n_het(calls: Column, low: int | None = None, high: int | None = None) -> Column:
    return count_calls(calls, lambda c: is_het(c["gt"]) & in_depth(c, low, high))


def alleles(calls: Column) -> Column:
    """All alleles of all calls, missing ones as null."""
    return F.flatten(F.transform(calls, lambda c: c["gt"]))


def known_alleles(calls: Column) -> Column:
    return F.filter(alleles(calls), lambda a: a.isNotNull())


def counts_of(values: Column) -> Column:
    """Array of (allele, n) in order of allele."""
    count = lambda v, a: F.struct(a.alias("allele"), F.size(F.filter(v, lambda x: x == a)).cast("long").alias("n"))
    return bound({"v": values}, lambda s: F.transform(F.array_sort(F.array_distinct(s["v"])), lambda a: count(s["v"], a)))


def allele_counts(calls: Column) -> Column:
    return counts_of(known_alleles(calls))


def largest(counts: Column) -> Column:
    return F.array_max(F.transform(counts, lambda c: c["n"]))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])


def masked(stat: Column, called: Column, least: int) -> Column:
    """Null where fewer genotypes than ``least`` are called."""
    return F.when(called >= least, stat) if least else stat


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return a.cast("double") / F.when(b != 0, b)


def major_frequency(calls: Column, least: int = MIN_GENOTYPES) -> Column:
    """The largest allele frequency."""
    share = bound({"c": allele_counts(calls)}, lambda s: ratio(largest(s["c"]), total(s["c"])))
    return masked(share, n_called(calls), least)


def major_count(calls: Column, ploidy: int, least: int = MIN_GENOTYPES) -> Column:
    """How many samples' worth of chromosomes the major allele has: samples - (chromosomes - missing - most) / ploidy."""
    counts = allele_counts(calls)
    n = F.size(calls)
    mac = n - (total(counts) - largest(counts)).cast("double") / ploidy
    return masked(F.when(total(counts) > 0, mac), n_called(calls), least)


def depth_major_frequency(calls: Column) -> Column:
    """The largest share of an allele in the reads of all samples (``ad``); an unknown depth is none."""
    sums = depth_sums(calls)
    whole = F.aggregate(sums, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return ratio(F.array_max(sums), whole)


def depth_sums(calls: Column) -> Column:
    """Reads by allele over all samples."""
    ads = F.transform(calls, lambda c: F.transform(F.coalesce(c["ad"], F.array().cast("array<int>")), lambda x: F.when(x > 0, x).otherwise(0).cast("long")))
    return F.aggregate(ads, F.array().cast("array<bigint>"), lambda acc, x: F.zip_with(acc, x, lambda p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0))))


def frequencies(calls: Column, least: int = MIN_GENOTYPES) -> Column:
    """Array of (allele, freq)."""
    counts = allele_counts(calls)
    whole = total(counts)
    return masked(F.transform(counts, lambda c: F.struct(c["allele"].alias("allele"), ratio(c["n"], whole).alias("freq"))), n_called(calls), least)


def observed_het(calls: Column, least: int = MIN_GENOTYPES, low: int | None = None, high: int | None = None) -> Column:
    called = n_called(calls, low, high)
    return masked(ratio(n_het(calls, low, high), called), called, least)


def expected_het(calls: Column, ploidy: int, least: int = MIN_GENOTYPES) -> Column:
    """1 - sum of p ** ploidy."""
    counts = allele_counts(calls)
    whole = total(counts)
    powers = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + F.pow(ratio(c["n"], whole), F.lit(float(ploidy))))
    return masked(F.when(whole > 0, 1 - powers), n_called(calls), least)


def unbiased_het(calls: Column, ploidy: int, least: int = MIN_GENOTYPES) -> Column:
    """Expected heterozygosity times 2n / (2n - 1), n genotypes, whatever the ploidy."""
    n = n_called(calls)
    return ratio(2 * n, 2 * n - 1) * expected_het(calls, ploidy, least)


def unbiased_het2(calls: Column, ploidy: int, least: int = MIN_GENOTYPES) -> Column:
    """Expected heterozygosity times n / (n - 1)."""
    n = n_called(calls)
    return ratio(n, n - 1) * expected_het(calls, ploidy, least)


def inbreeding(calls: Column, ploidy: int, least: int = MIN_GENOTYPES) -> Column:
    expected = expected_het(calls, ploidy, least)
    return 1 - observed_het(calls, least) / F.when(expected != 0, expected)


def major_allele(calls: Column) -> Column:
    """The most frequent allele, the lowest of equals."""
    counts = allele_counts(calls)
    best = F.array_max(F.transform(counts, lambda c: F.struct(c["n"].alias("n"), (-c["allele"]).alias("a"))))
    return -best["a"]


def dosages(calls: Column) -> Column:
    """For each call the number of alleles that aren't the major one, null if any is missing."""
    dose = lambda c, major: F.when(~is_missing(c["gt"]), F.size(F.filter(c["gt"], lambda a: a != major)))
    return bound({"major": major_allele(calls)}, lambda s: F.transform(calls, lambda c: dose(c, s["major"])))


def times(calls: Column, allele: int) -> Column:
    """How often an allele occurs."""
    return F.size(F.filter(alleles(calls), lambda a: a == allele)).cast("long")


def genotype_counts(calls: Column) -> Column:
    """Array of (gt, n) of unordered genotypes without missing alleles."""
    gts = F.transform(F.filter(calls, lambda c: ~is_missing(c["gt"])), lambda c: F.array_sort(c["gt"]))
    count = lambda all_, gt: F.struct(gt.alias("gt"), F.size(F.filter(all_, lambda x: x == gt)).cast("long").alias("n"))
    return bound({"gts": gts}, lambda s: F.transform(F.array_sort(F.array_distinct(s["gts"])), lambda gt: count(s["gts"], gt)))
