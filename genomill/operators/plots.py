"""The numbers behind plots. Drawing is left to whatever library is there; ``draw`` uses matplotlib if it can be imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .histograms import boxplot_of, histogram_of, percentiles_of
from .samples import calc_stats_by_sample, depth_histograms_by_sample
from .table import Variations
from .variant_stats import calc_missing_gt

boxplot_from_distribs = boxplot_of


def boxplot(rows: DataFrame, by: list[str], n_bins: int = 100, range_: tuple | None = None) -> DataFrame:
    """Boxes of the column x for each group."""
    return boxplot_of(histogram_of(rows, n_bins, range_, by=by), by)


def histogram(rows: DataFrame, n_bins: int = 20, range_: tuple | None = None) -> DataFrame:
    return histogram_of(rows, n_bins, range_)


def stacked_histograms(rows: DataFrame, by: list[str], n_bins: int = 20, range_: tuple | None = None) -> DataFrame:
    """With ``base``: where a group's bar begins on top of those before it."""
    hist = histogram_of(rows, n_bins, range_, by=by)
    return hist.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def barplot(rows: DataFrame, by: list[str], stacked: bool = True) -> DataFrame:
    """(by..., name, value) with ``base`` if stacked."""
    order = Window.partitionBy(*by).orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("value").over(order), F.lit(0))) if stacked else rows


def hist2d_margins(hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of a 2-D histogram over rows and over columns."""
    return hist.groupBy("x_bin").agg(F.sum("n").alias("n")), hist.groupBy("y_bin").agg(F.sum("n").alias("n"))


#: Ranges of values that are ranked each by itself.
CUTS = 200


def qq(rows: DataFrame, quantile) -> DataFrame:
    """x in order beside the quantiles of a distribution: ``quantile`` is a column function of a share.

    Values are ranked within ranges between approximate quantiles, after as many as the ranges before them have.
    """
    rows = rows.where("x is not null").select(F.col("x").cast("double").alias("x"))
    cuts = sorted(set(rows.agg(F.percentile_approx("x", [i / CUTS for i in range(1, CUTS)])).first()[0] or []))  # CUTS numbers at most
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("x")))
    rows = rows.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("x")) + F.col("_before")
    rows = rows.join(F.broadcast(sizes), "_part").select("x", ((place - 0.5) / F.col("_all")).alias("share"))
    return rows.withColumn("expected", quantile(F.col("share")))


def boxplots_of_series(hists: dict[str, DataFrame], by: list[str] | None = None) -> DataFrame:
    """series and what ``boxplot_of`` gives, for several distributions side by side."""
    out = None
    for name, hist in hists.items():
        one = boxplot_of(hist, by).withColumn("series", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def sample_missing_het(v: Variations) -> DataFrame:
    """sample_idx, sample, missing, obs_het: a point for each sample."""
    names = v.sample_table().select("sample_idx", "sample").distinct()
    stats = calc_stats_by_sample(v).select("sample_idx", "obs_het").join(calc_missing_gt(v, axis=0), "sample_idx")
    return stats.join(F.broadcast(names), "sample_idx").select("sample_idx", "sample", "missing", "obs_het")  # a row for each sample


def sample_depths(v: Variations, range_: tuple | None = None, n_bins: int = 20) -> DataFrame:
    """kind, sample_idx, bin, lo, hi, n: depth histograms of all, called, homozygous and heterozygous genotypes."""
    return depth_histograms_by_sample(v, range_, n_bins)


def manhattan(rows: DataFrame, gap: int = 0) -> DataFrame:
    """(chrom, pos, value) with ``x``: the position after all chromosomes before, and ``colour``, 0 or 1 in turns."""
    ends = rows.groupBy("chrom").agg(F.max("pos").cast("long").alias("_end"))
    order = Window.orderBy("chrom")
    offset = F.coalesce(F.sum(F.col("_end") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("chrom", offset.alias("_before"), ((F.row_number().over(order) - 1) % 2).alias("colour"))
    return rows.join(F.broadcast(ends), "chrom").withColumn("x", F.col("pos") + F.col("_before")).drop("_before")  # a row per chromosome


def lines(rows: DataFrame) -> DataFrame:
    return rows.orderBy("x")


def violins(rows: DataFrame, by: list[str], n_bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Histograms with widths relative to the widest bin, and the quartiles of each group."""
    hist = histogram_of(rows, n_bins, by=by)
    most = F.max("n").over(Window.partitionBy(*by))
    return hist.withColumn("width", F.col("n") / F.when(most > 0, most)), percentiles_of(hist, by=by)


def draw(pdf, kind: str, path: str, **options) -> bool:
    """Draws a small pandas table to a file; False where matplotlib is missing."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    axes = pdf.plot(kind=kind, **options)
    axes.figure.savefig(path)
    pyplot.close(axes.figure)
    return True
