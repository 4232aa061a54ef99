"""Statistics of each sample: one pass of partial sums over the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from .histograms import BINS, histogram_of
from .table import Variations


def _bounded(low: int | None, high: int | None):
    dp = F.coalesce("dp", F.lit(-1))
    ok = F.lit(True)
    if low:
        ok = ok & (dp >= low)
    if high is not None:
        ok = ok & (dp <= high)
    return ok


def calc_obs_het_by_sample(v: Variations, min_call_dp: int = 0, max_call_dp: int | None = None) -> DataFrame:
    gt, ok = F.col("gt"), _bounded(min_call_dp, max_call_dp)
    sums = v.long().groupBy("sample_idx").agg(F.count_if(g.is_het(gt) & ok).alias("het"), F.count_if(~g.is_missing(gt) & ok).alias("called"))
    return sums.select("sample_idx", g.ratio(F.col("het"), F.col("called")).alias("obs_het"))


def calc_stats_by_sample(v: Variations, min_call_dp: int = 0, max_call_dp: int | None = None) -> DataFrame:
    """sample_idx, called_rate, obs_het, obs_hom."""
    gt, ok = F.col("gt"), _bounded(min_call_dp, max_call_dp)
    sums = v.long().groupBy("sample_idx").agg(
        F.count_if(~g.is_missing(gt)).alias("all_called"), F.count(F.lit(1)).alias("n"), F.count_if(~g.is_missing(gt) & ok).alias("called"), F.count_if(g.is_het(gt) & ok).alias("het"), F.count_if(g.is_hom(gt) & ok).alias("hom")
    )
    return sums.select("sample_idx", g.ratio(F.col("all_called"), F.col("n")).alias("called_rate"), g.ratio(F.col("het"), F.col("called")).alias("obs_het"), g.ratio(F.col("hom"), F.col("called")).alias("obs_hom"))


def depth_histograms_by_sample(v: Variations, range_: tuple | None = None, n_bins: int = BINS) -> DataFrame:
    """kind (all, called, het, hom), sample_idx, bin, lo, hi, n of depths."""
    gt = F.col("gt")
    kinds = F.array_compact(F.array(F.lit("all"), F.when(~g.is_missing(gt), F.lit("called")), F.when(g.is_het(gt), F.lit("het")), F.when(g.is_hom(gt), F.lit("hom"))))
    rows = v.long().select("sample_idx", F.col("dp").cast("double").alias("x"), F.explode(kinds).alias("kind"))
    return histogram_of(rows, n_bins, range_, by=["kind", "sample_idx"])


def calc_gt_type_stats(v: Variations) -> DataFrame:
    """sample_idx, hom_ref, het, hom_alt, missing: counts."""
    gt = F.col("gt")
    tests = {"hom_ref": g.is_hom_ref(gt), "het": g.is_het(gt), "hom_alt": g.is_hom_alt(gt), "missing": g.is_missing(gt)}
    return v.long().groupBy("sample_idx").agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


def calc_depth_mean_by_sample(v: Variations, compat: bool = False) -> DataFrame:
    """The mean depth of each sample; ``compat`` counts an unknown depth as -1 and divides by all variants."""
    if compat:
        return v.long().groupBy("sample_idx").agg((F.sum(F.coalesce("dp", F.lit(-1))) / F.count(F.lit(1))).alias("dp_mean"))
    return v.long().groupBy("sample_idx").agg(F.avg("dp").alias("dp_mean"))


def stats_table(v: Variations) -> DataFrame:
    """sample, call_rate, heterozygosity, median_dp: what the report of samples writes."""
    from .histograms import percentiles_of

    stats = calc_stats_by_sample(v)
    hist = depth_histograms_by_sample(v).where("kind = 'called'").drop("kind")
    median = percentiles_of(hist, (0.5,), by=["sample_idx"]).select("sample_idx", F.col("value").alias("median_dp"))
    names = v.sample_table().select("sample_idx", "sample").distinct()
    out = names.join(stats, "sample_idx").join(median, "sample_idx", "left")
    return out.orderBy("sample_idx").select("sample", F.col("called_rate").alias("call_rate"), F.col("obs_het").alias("heterozygosity"), "median_dp")
