"""Row and sample filters.

A filter has a statistic, from which follows a condition that is never null. ``flt(v)`` gives a
``Filtered``: the kept and the discarded variations, how many there are, the selection, and a
histogram of the statistic; each is planned only when it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions.special import contingency_column, poisson_quantile
from .histograms import histogram_of
from .table import Variations

BINS = 20


@dataclass
class Filtered:
    source: Variations
    condition: Column
    stat: Column | None
    bins: int = BINS
    range: tuple[float, float] | None = None

    @property
    def kept(self) -> Variations:
        return self.source.having(self.source.df.where(self.condition))

    @property
    def discarded(self) -> Variations:
        return self.source.having(self.source.df.where(~self.condition))

    @property
    def selection(self) -> DataFrame:
        """row_idx, selected."""
        return self.source.df.select("row_idx", self.condition.alias("selected"))

    @property
    def stats(self) -> DataFrame:
        """One row: n_kept, n_filtered_out, tot."""
        return self.source.df.agg(F.count_if(self.condition).alias("n_kept"), F.count_if(~self.condition).alias("n_filtered_out"), F.count(F.lit(1)).alias("tot"))

    @property
    def histogram(self) -> DataFrame:
        if self.stat is None:
            raise ValueError("this filter has no statistic")
        return histogram_of(self.source.df.select(self.stat.cast("double").alias("x")), self.bins, self.range)


class BaseFilter:
    """keep_missing keeps variants without a statistic; samples restricts the statistic to some samples."""

    def __init__(self, low: float | None = None, high: float | None = None, samples: list[str] | None = None, keep_missing: bool = False, n_bins: int = BINS, range_: tuple[float, float] | None = None):
        self.low, self.high, self.samples, self.keep_missing, self.n_bins, self.range = low, high, samples, keep_missing, n_bins, range_

    def calls(self, v: Variations) -> Column:
        return g.pick(F.col("calls"), None if self.samples is None else v.indexes(self.samples))

    def stat(self, v: Variations) -> Column | None:
        return None

    def condition(self, v: Variations) -> Column:
        stat = self.stat(v)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (stat >= self.low)
        if self.high is not None:
            ok = ok & (stat <= self.high)
        if self.low is None and self.high is None:
            return F.lit(True)
        return F.coalesce(ok, F.lit(bool(self.keep_missing)))

    def __call__(self, v: Variations) -> Filtered:
        return Filtered(v, self.condition(v), self.stat(v), self.n_bins, self.range)


class MinCalledGTsFilter(BaseFilter):
    def __init__(self, min_called: float | None = None, rates: bool = True, **kwargs):
        super().__init__(low=min_called, **kwargs)
        self.rates = rates

    def stat(self, v):
        calls = self.calls(v)
        return g.ratio(g.n_called(calls), F.size(calls)) if self.rates else g.n_called(calls)


class _Diploid(BaseFilter):
    def condition(self, v):
        if v.ploidy != 2:
            raise ValueError("only for diploids")
        return F.coalesce(F.forall(self.calls(v), self.good), F.lit(False))

    @staticmethod
    def good(call: Column) -> Column:
        raise NotImplementedError


class NoMissingGTsFilter(_Diploid):
    @staticmethod
    def good(call):
        return ~g.is_missing(call["gt"])


class NoMissingGTsOrHetFilter(_Diploid):
    @staticmethod
    def good(call):
        return g.is_hom(call["gt"])


class VariableAndNotAllMissing(BaseFilter):
    """At least one called genotype and more than one allele."""

    def condition(self, v):
        calls = self.calls(v)
        return (g.n_called(calls) > 0) & (F.size(g.allele_counts(calls)) > 1)


class MafFilter(BaseFilter):
    def __init__(self, min_maf: float | None = None, max_maf: float | None = None, min_num_genotypes: int = g.MIN_GENOTYPES, **kwargs):
        super().__init__(min_maf, max_maf, **kwargs)
        self.least = min_num_genotypes

    def stat(self, v):
        return g.major_frequency(self.calls(v), self.least)


class AlleleObservationBasedMafFilter(BaseFilter):
    def __init__(self, min_maf: float | None = None, max_maf: float | None = None, **kwargs):
        super().__init__(min_maf, max_maf, **kwargs)

    def stat(self, v):
        return g.depth_major_frequency(self.calls(v))


class MacFilter(BaseFilter):
    def __init__(self, min_mac: float | None = None, max_mac: float | None = None, min_num_genotypes: int = g.MIN_GENOTYPES, **kwargs):
        super().__init__(min_mac, max_mac, **kwargs)
        self.least = min_num_genotypes

    def stat(self, v):
        return g.major_count(self.calls(v), v.ploidy, self.least)


class ObsHetFilter(BaseFilter):
    def __init__(self, min_het: float | None = None, max_het: float | None = None, min_num_genotypes: int = g.MIN_GENOTYPES, min_call_dp: int = 0, **kwargs):
        super().__init__(min_het, max_het, **kwargs)
        self.least, self.min_dp = min_num_genotypes, min_call_dp

    def stat(self, v):
        return g.observed_het(self.calls(v), self.least, self.min_dp)


class SNPQualFilter(BaseFilter):
    def __init__(self, min_qual: float | None = None, max_qual: float | None = None, **kwargs):
        if kwargs.get("samples") is not None:
            raise ValueError("quality is not of samples")
        super().__init__(min_qual, max_qual, **kwargs)

    def stat(self, v):
        return F.col("qual")


class SNPPositionFilter(BaseFilter):
    """Variants in any of the regions, (chrom,) or (chrom, start, stop), the stop not included; reverse: in none."""

    def __init__(self, regions: list[tuple], reverse: bool = False):
        super().__init__()
        self.regions, self.reverse = regions, reverse

    def condition(self, v):
        inside = F.lit(False)
        for chrom, *span in self.regions:
            one = F.col("chrom") == chrom
            if span:
                one = one & (F.col("pos") >= span[0]) & (F.col("pos") < span[1])
            inside = inside | one
        inside = F.coalesce(inside, F.lit(False))
        return ~inside if self.reverse else inside


class IndelFilter(BaseFilter):
    """Keeps variants none of whose other alleles is longer than one base; the reference's length does not count."""

    def condition(self, v):
        return F.coalesce(F.forall("alt", lambda a: F.coalesce(F.length(a), F.lit(0)) < 2), F.lit(True))


class NonBiallelicFilter(BaseFilter):
    def __init__(self, samples: list[str] | None = None, keep_monomorphic: bool = False, reverse: bool = False):
        super().__init__(samples=samples)
        self.mono, self.reverse = keep_monomorphic, reverse

    def condition(self, v):
        n = F.size(g.allele_counts(self.calls(v)))
        ok = n <= 2 if self.mono else n == 2
        return ~ok if self.reverse else ok


class Chi2GtFreqs2SampleSetsFilter(BaseFilter):
    """Genotype counts of two sets of samples: keeps p >= min_pval; tables with an empty side are dropped."""

    def __init__(self, samples1: list[str], samples2: list[str], min_pval: float, **kwargs):
        super().__init__(low=min_pval, **kwargs)
        self.sets = samples1, samples2

    def stat(self, v):
        one, two = (g.genotype_counts(g.pick(F.col("calls"), v.indexes(s))) for s in self.sets)
        return contingency_column(one, two)


class PseudoHetDuplicationFilter(BaseFilter):
    """Drops variants where too many calls have a depth beyond a Poisson bound of their sample's mean, and too many are heterozygous."""

    def __init__(self, sample_dp_means: list[float], max_high_dp_freq: float, max_obs_het: float | None, poisson_percent_for_high_dp_call: float = 1, **kwargs):
        super().__init__(**kwargs)
        self.cutoffs = [poisson_quantile(m, 1 - poisson_percent_for_high_dp_call / 100) for m in sample_dp_means]
        self.max_high, self.max_het = max_high_dp_freq, max_obs_het

    def _calls(self):
        cut = F.array(*[F.lit(c) for c in self.cutoffs])
        return F.zip_with("calls", cut, lambda c, k: F.struct((c["dp"] > k).alias("high"), (c["dp"] > 0).alias("any"), g.is_het(c["gt"]).alias("het"), (~g.is_missing(c["gt"])).alias("called")))

    @staticmethod
    def _n(calls, test):
        return F.size(F.filter(calls, lambda c: F.coalesce(test(c), F.lit(False))))

    def stat(self, v):
        calls = self._calls()
        return g.ratio(self._n(calls, lambda c: c["high"]), self._n(calls, lambda c: c["any"]))

    def condition(self, v):
        calls = self._calls()
        het = g.ratio(self._n(calls, lambda c: c["het"]), self._n(calls, lambda c: c["called"]))
        return ~F.coalesce((self.stat(v) > self.max_high) & (het > self.max_het), F.lit(False))


class PseudoHetDuplicationFilter2(PseudoHetDuplicationFilter):
    """Keeps variants where the share of deep heterozygous calls is at most a bound."""

    def __init__(self, sample_dp_means: list[float], max_high_dp_freq: float, poisson_percent_for_high_dp_call: float = 1, **kwargs):
        super().__init__(sample_dp_means, max_high_dp_freq, None, poisson_percent_for_high_dp_call, **kwargs)

    def stat(self, v):
        calls = self._calls()
        return g.ratio(self._n(calls, lambda c: c["high"] & c["het"]), self._n(calls, lambda c: c["any"]))

    def condition(self, v):
        return F.coalesce(self.stat(v) <= self.max_high, F.lit(False))


class OrFilter:
    """Variants that any of the filters keeps."""

    def __init__(self, filters: list[BaseFilter]):
        self.filters = filters

    def __call__(self, v: Variations) -> Filtered:
        ok = F.lit(False)
        for f in self.filters:
            ok = ok | f.condition(v)
        return Filtered(v, ok, None)


class FieldValueFilter(BaseFilter):
    def __init__(self, field: str, value, **kwargs):
        super().__init__(**kwargs)
        self.field, self.value = field, value

    def condition(self, v):
        return F.coalesce(F.col(self.field) == self.value, F.lit(False))


class FieldFilter:
    def __init__(self, kept_fields: list[str] | None = None, ignored_fields: list[str] | None = None):
        self.kept, self.ignored = kept_fields, ignored_fields

    def __call__(self, v: Variations) -> Variations:
        return v.fields(self.kept, self.ignored)


class SamplesFilterByIndex:
    def __init__(self, samples_col_idxs: list[int] | list[bool], reverse: bool = False):
        idxs = samples_col_idxs
        self.idxs = [i for i, x in enumerate(idxs) if x] if idxs and all(isinstance(i, bool) for i in idxs) else list(idxs)
        self.reverse = reverse

    def __call__(self, v: Variations) -> Variations:
        return v.only_samples(self.idxs, self.reverse)


class SampleFilter:
    def __init__(self, samples: list[str], reverse: bool = False):
        if len(set(samples)) != len(samples):
            raise ValueError("repeated samples")
        self.samples, self.reverse = samples, reverse

    def __call__(self, v: Variations) -> Variations:
        return v.only_named(self.samples, self.reverse)


class VarsSamplingFilter:
    """An exact share of the variants, drawn by a seed."""

    def __init__(self, sample_rate: float, seed: int = 0):
        self.rate, self.seed = sample_rate, seed

    def _n(self, v: Variations) -> int:
        return round(v.num_variations() * self.rate)

    def __call__(self, v: Variations) -> Filtered:
        chosen = v.df.select("row_idx").orderBy(F.xxhash64("row_idx", F.lit(self.seed)), "row_idx").limit(self._n(v)).withColumn("_chosen", F.lit(True))
        marked = v.df.join(chosen, "row_idx", "left")
        return Filtered(v.having(marked), F.coalesce("_chosen", F.lit(False)), None)


class VarsSamplingFilter2(VarsSamplingFilter):
    """An exact number of variants."""

    def __init__(self, num_vars: int, seed: int = 0):
        self.num, self.seed = num_vars, seed

    def _n(self, v):
        n = v.num_variations()
        if self.num > n:
            raise ValueError(f"{self.num} variants wanted, {n} there")
        return self.num


def filter_variation_density(v: Variations, max_density: int, window: int) -> Variations:
    """Variants with at most so many variants within half a window on either side, themselves included."""
    from .windows import with_density

    return v.having(with_density(v.df, window, "_density").where(F.col("_density") <= max_density).drop("_density"))


def filter_samples_by_missing_rate(v: Variations, min_called_rate: float | None = None, max_het: float | None = None, samples: list[str] | None = None) -> Variations:
    """Samples with a called rate above, and heterozygous calls per variant below, the bounds."""
    per = v.long().groupBy("sample_idx").agg(F.avg((~g.is_missing(F.col("gt"))).cast("int")).alias("rate"), F.avg(g.is_het(F.col("gt")).cast("int")).alias("het")).collect()
    wanted = None if samples is None else set(v.indexes(samples))
    good = [r.sample_idx for r in per if (min_called_rate is None or r.rate > min_called_rate) and (max_het is None or r.het < max_het) and (wanted is None or r.sample_idx in wanted)]
    return v.only_samples(good)


def select_by(v: Variations, test: Callable[[Variations], Column]) -> Filtered:
    """Any condition of the user's."""
    return Filtered(v, F.coalesce(test(v), F.lit(False)), None)
