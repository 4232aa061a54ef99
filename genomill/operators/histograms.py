"""Histograms and distributions: equal bins over a range, the last one closed on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as g
from .table import Variations

BINS = 20


def _usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _bin(x: Column, low: Column, width: Column, n: int) -> Column:
    return F.least(F.floor((x - low) / width), F.lit(n - 1)).cast("int")


def _bounds(rows: DataFrame, column: str, range_: tuple[float, float] | None) -> DataFrame:
    spark = rows.sparkSession
    if range_ is not None:
        lo, hi = map(float, range_)
        return spark.createDataFrame([(lo, hi if hi > lo else lo + 1.0)], "lo double, hi double")
    ends = rows.where(_usable(F.col(column))).agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    same = F.col("lo") == F.col("hi")
    ends = ends.select(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"), same.alias("same"))
    return ends.select(F.when(F.col("same"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("same"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))


def histogram_of(rows: DataFrame, n_bins: int = BINS, range_: tuple[float, float] | None = None, column: str = "x", weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by...), bin, lo, hi, n: every bin is there, empty ones with 0. Values that are null, not finite or out of range don't count."""
    by = by or []
    if range_ is not None and not all(abs(float(e)) != float("inf") for e in range_):
        raise ValueError("the range is not finite")
    # A statistic is a long expression: generated once, it is not evaluated again for each comparison.
    keep = [*by, *([weight] if weight and weight != column else [])]
    rows = rows.select(*keep, F.explode(F.array(F.col(column))).alias(column))
    lo, hi = _limits(rows, column, range_)
    width = (F.lit(hi) - F.lit(lo)) / n_bins
    x = F.col(column).cast("double")
    inside = rows.where(_usable(x) & (x >= lo) & (x <= hi))
    n = F.sum(weight).cast("double") if weight else F.count(F.lit(1))
    found = inside.groupBy(*by, _bin(x, F.lit(lo), width, n_bins).alias("bin")).agg(n.alias("n"))
    bins = rows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        bins = rows.select(*by).distinct().crossJoin(F.broadcast(bins))  # n_bins rows
    out = bins.join(found, [*by, "bin"], "left")
    edge = lambda k: F.lit(lo) + k * width
    return out.select(*by, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def _limits(rows: DataFrame, column: str, range_: tuple[float, float] | None) -> tuple[float, float]:
    """The ends of a histogram: those given, or the least and largest value, looked up once."""
    return tuple(_bounds(rows, column, range_).first())


def histogram_for_stat(v: Variations, stat, n_bins: int = BINS, range_: tuple[float, float] | None = None) -> DataFrame:
    """Histogram of what a statistic of ``variant_stats`` gives in its last column."""
    rows = stat(v)
    return histogram_of(rows.select(F.col(rows.columns[-1]).cast("double").alias("x")), n_bins, range_)


def cumulative(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """With ``cum``: the counts of a bin and of all above it."""
    return hist.withColumn("cum", F.sum("n").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col("bin").desc())))


def called_by_depth(v: Variations, depths: list[int]) -> DataFrame:
    """depth, bin, lo, hi, n: histograms of how many samples are called with at least a depth, over [0, samples + 1]."""
    calls, s = F.col("calls"), len(v.samples)
    counts = [F.struct(F.lit(d).alias("depth"), g.n_called(calls, d).alias("x")) for d in depths]
    rows = v.df.select(F.explode(F.array(*counts)).alias("s")).select("s.depth", "s.x")
    return histogram_of(rows, s, (0, s + 1), by=["depth"])


def hist2d(rows: DataFrame, n_bins: int, x_range: tuple[float, float] | None, y_range: tuple[float, float] | None, mean: str | None = None) -> DataFrame:
    """x_bin, y_bin, n (or the mean of a column, 0 where there is none) of the columns x and y; only bins that have rows."""
    ok = rows.where(_usable(F.col("x").cast("double")) & _usable(F.col("y").cast("double")))
    ends = F.broadcast(_bounds(ok, "x", x_range).crossJoin(_bounds(ok, "y", y_range).toDF("lo2", "hi2")))
    inside = ok.crossJoin(ends).where(F.col("x").between(F.col("lo"), F.col("hi")) & F.col("y").between(F.col("lo2"), F.col("hi2")))
    x = _bin(F.col("x").cast("double"), F.col("lo"), (F.col("hi") - F.col("lo")) / n_bins, n_bins)
    y = _bin(F.col("y").cast("double"), F.col("lo2"), (F.col("hi2") - F.col("lo2")) / n_bins, n_bins)
    value = F.coalesce(F.avg(mean), F.lit(0.0)).alias("mean") if mean else F.count(F.lit(1)).alias("n")
    return inside.groupBy(x.alias("x_bin"), y.alias("y_bin")).agg(value)


def _observations(v: Variations, mask=None) -> DataFrame:
    rows = v.long().withColumn("x", F.col("ro")).withColumn("y", F.array_max("ao"))
    return rows if mask is None else rows.where(F.coalesce(mask(F.col("gt")), F.lit(False)))


def hist2d_allele_observations(v: Variations, n_bins: int = BINS, range_: tuple | None = None, mask=None) -> DataFrame:
    """Reads of the reference against the most read other allele; ``mask`` picks calls by genotype."""
    return hist2d(_observations(v, mask), n_bins, *(range_ or (None, None)))


def hist2d_gq_allele_observations(v: Variations, n_bins: int = BINS, range_: tuple | None = None, mask=None) -> DataFrame:
    """The mean genotype quality in each of those bins."""
    return hist2d(_observations(v, mask), n_bins, *(range_ or (None, None)), mean="gq")


def hist2d_het_allele_freq(v: Variations, n_bins: int = BINS, allele_freq_range=None, het_range=None, min_call_dp_for_het: int | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """Major allele frequency against heterozygosity, both of called genotypes; y_bin counts from the top."""
    gts = F.filter("calls", lambda c: ~g.is_missing(c["gt"]) & g.in_depth(c, min_call_dp_for_het))
    counts = g.counts_of(F.flatten(F.transform(gts, lambda c: c["gt"])))
    n, s = F.size(gts), F.size("calls")
    enough = (n == s) | (n >= min_num_genotypes)
    rows = v.df.where(enough).select(g.ratio(g.largest(counts), g.total(counts)).alias("x"), g.ratio(F.size(F.filter(gts, lambda c: g.is_het(c["gt"]))), n).alias("y"))
    out = hist2d(rows, n_bins, allele_freq_range, het_range)
    return out.withColumn("y_bin", F.lit(n_bins - 1) - F.col("y_bin"))


def field_histogram(v: Variations, field: str, n_bins: int = BINS, range_: tuple | None = None, sample: str | None = None, mask=None) -> DataFrame:
    """sample_idx, bin, lo, hi, n of a field of the calls, for one sample or for each; the automatic range is [max(0, min), max + 1]."""
    rows = v.long()
    if sample is not None:
        rows = rows.where(F.col("sample_idx") == v.indexes([sample])[0])
    if mask is not None:
        rows = rows.where(F.coalesce(mask(F.col("gt")), F.lit(False)))
    rows = rows.select("sample_idx", F.col(field).cast("double").alias("x"))
    if range_ is None:
        lo, hi = rows.agg(F.min("x"), F.max("x")).first()
        range_ = (max(0.0, lo or 0.0), (hi or 0.0) + 1)
    return histogram_of(rows, n_bins, range_, by=["sample_idx"])


def maf_depth_histograms(v: Variations, min_depth: int = 10, n_bins: int = 2 * BINS) -> DataFrame:
    from .variant_stats import calc_maf_depth

    rows = calc_maf_depth(v, min_depth).select("sample_idx", F.col("maf_depth").alias("x"))
    return histogram_of(rows, n_bins, (0, 1), by=["sample_idx"])


def call_dp_histograms(v: Variations, sample: str, range_: tuple | None = None, n_bins: int = BINS) -> DataFrame:
    """kind (hom, het), bin, lo, hi, n of a sample's depths."""
    rows = v.long().where((F.col("sample_idx") == v.indexes([sample])[0]) & ~g.is_missing(F.col("gt")))
    rows = rows.select(F.when(g.is_het(F.col("gt")), "het").otherwise("hom").alias("kind"), F.col("dp").cast("double").alias("x"))
    return histogram_of(rows, n_bins, range_, by=["kind"])


def percentiles_of(hist: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75), by: list[str] | None = None) -> DataFrame:
    """(by...), share, value: linear between the middles of bins over the cumulative frequency, held at both ends."""
    by = by or []
    part = Window.partitionBy(*(by or [F.lit(1)]))
    up = part.orderBy("bin")
    x = (F.col("lo") + F.col("hi")) / 2
    h = hist.withColumn("x", x).withColumn("f", F.sum("n").over(up) / F.sum("n").over(part)).where("f is not null")
    h = h.withColumn("f0", F.lag("f").over(up)).withColumn("x0", F.lag("x").over(up))
    last = F.row_number().over(part.orderBy(F.col("bin").desc())) == 1
    h = h.withColumn("last", last).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    s = F.col("share")
    inside = F.col("f0").isNotNull() & (s > F.col("f0")) & (s <= F.col("f"))
    value = F.when(F.col("f0").isNull() & (s <= F.col("f")), F.col("x")).when(inside, F.col("x0") + (F.col("x") - F.col("x0")) * (s - F.col("f0")) / F.when(F.col("f") != F.col("f0"), F.col("f") - F.col("f0"))).when(F.col("last") & (s > F.col("f")), F.col("x"))
    return h.withColumn("value", value).where("value is not null").groupBy(*by, "share").agg(F.min("value").alias("value"))


def boxplot_of(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by...), p5, q1, med, q3, p95, mean, cilo, cihi by the bins that hold those shares of the counts."""
    by = by or []
    part = Window.partitionBy(*(by or [F.lit(1)]))
    h = hist.withColumn("x", (F.col("lo") + F.col("hi")) / 2).withColumn("all", F.sum("n").over(part)).withColumn("cum", F.sum("n").over(part.orderBy("bin")))
    at = lambda s: F.min(F.when(F.col("cum") >= F.lit(s) * F.col("all"), F.col("x")))
    out = h.groupBy(*by).agg(*[at(s).alias(c) for s, c in ((0.05, "p5"), (0.25, "q1"), (0.5, "med"), (0.75, "q3"), (0.95, "p95"))], (F.sum(F.col("x") * F.col("n")) / F.when(F.sum("n") > 0, F.sum("n"))).alias("mean"), F.sum("n").alias("n"))
    half = 1.57 * (F.col("q3") - F.col("q1")) / F.sqrt(F.when(F.col("n") > 0, F.col("n")))
    return out.withColumn("cilo", F.col("med") - half).withColumn("cihi", F.col("med") + half)


def min_max(rows: DataFrame, column: str) -> DataFrame:
    """One row: lo, hi of the known values; of none +inf and -inf."""
    x = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    return rows.agg(F.coalesce(F.min(x), F.lit(float("inf"))).alias("lo"), F.coalesce(F.max(x), F.lit(float("-inf"))).alias("hi"))
