"""Windows along chromosomes, and tracks of statistics in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as g
from .table import Variations


#: Positions that are counted by one task, unless a window is wider.
BLOCK = 1_000_000


def with_density(df: DataFrame, window: int, name: str = "density") -> DataFrame:
    """df with the number of variants within (window - 1) / 2 on either side on the chromosome, the variant itself included.

    Blocks of positions are counted by themselves; places near an edge are there a second time for the block beyond it.
    """
    half = (window - 1) // 2
    width = max(BLOCK, 4 * window)
    pos = F.col("pos").cast("long")
    block = F.floor(pos / width)
    edge = F.array_compact(F.array(F.when(pos - block * width < half, block - 1), F.when((block + 1) * width - pos <= half, block + 1)))
    near = df.select("chrom", "pos", F.explode(edge).alias("_block"), F.lit(False).alias("_own"))
    rows = df.withColumn("_block", block).withColumn("_own", F.lit(True)).unionByName(near, allowMissingColumns=True)
    n = F.count(F.lit(1)).over(Window.partitionBy("chrom", "_block").orderBy(pos).rangeBetween(-half, half))
    return rows.withColumn(name, n).where("_own").drop("_block", "_own")


def calc_snp_density(v: Variations, window: int) -> DataFrame:
    return with_density(v.df.select("row_idx", "chrom", "pos"), window)


def window_explode(df: DataFrame, size: int, step: int | None = None, after_start: bool = False, to_last: bool = True) -> DataFrame:
    """A row per window that a variant lies in, with win_start.

    Windows of a chromosome start at its first position and every ``step`` from there; they hold
    [start, start + size), or (start, start + size] with ``after_start``. Without ``to_last`` they
    start before the last position only.
    """
    step = step or size
    ends = df.groupBy("chrom").agg(F.min("pos").cast("long").alias("_first"), F.max("pos").cast("long").alias("_last"))
    rows = df.join(F.broadcast(ends), "chrom")  # a row per chromosome
    off = F.col("pos").cast("long") - F.col("_first") - (1 if after_start else 0)
    newest = F.floor(off / step)
    oldest = F.greatest(F.floor((off - size) / step) + 1, F.lit(0).cast("long"))
    stop = F.col("_last") if to_last else F.col("_last") - 1
    newest = F.least(newest, F.floor((stop - F.col("_first")) / step))
    rows = rows.where((off >= 0) & (newest >= oldest)).withColumn("_w", F.explode(F.sequence(oldest, newest)))
    return rows.withColumn("win_start", F.col("_first") + F.col("_w") * step).drop("_first", "_last", "_w")


def iterate_wins(v: Variations, size: int, step: int | None = None, chroms: list[str] | None = None) -> DataFrame:
    """The variants of each window, tumbling or sliding."""
    df = v.df if chroms is None else v.df.where(F.col("chrom").isin(chroms))
    return window_explode(df, size, step)


def window_stat(rows: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """chrom, win_start, stat: the sum of (chrom, pos, stat) in [start, start + size) over the size; windows start before the last position.

    Rows without a statistic don't count, and windows without rows have 0.
    """
    step = step or size
    rows = rows.where(F.col("stat").isNotNull() & ~F.isnan("stat"))
    sums = window_explode(rows, size, step, to_last=False).groupBy("chrom", "win_start").agg(F.sum("stat").alias("sum"))
    ends = rows.groupBy("chrom").agg(F.min("pos").cast("long").alias("a"), F.max("pos").cast("long").alias("b")).where("b > a")
    starts = ends.select("chrom", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.lit(step).cast("long"))).alias("win_start"))
    return starts.join(sums, ["chrom", "win_start"], "left").select("chrom", "win_start", (F.coalesce("sum", F.lit(0.0)) / size).alias("stat"))


def to_wig(rows: DataFrame, size: int | None = None, step: int | None = None, name: str | None = None, description: str = "") -> DataFrame:
    """Lines of a wiggle track of (chrom, pos, stat), in order: ``ord`` and ``value``."""
    step = step or size or 1
    stats = rows.where(F.col("stat").isNotNull()) if size is None else window_stat(rows, size, step).withColumnRenamed("win_start", "pos")
    body = stats.select("chrom", F.lit(1).alias("k"), F.col("pos").cast("long").alias("pos"), F.concat_ws(" ", F.col("pos").cast("string"), F.col("stat").cast("string")).alias("value") if size is None else F.col("stat").cast("string").alias("value"))
    first = stats.groupBy("chrom").agg(F.min("pos").cast("string").alias("p"))
    head = F.concat(F.lit("variableStep chrom="), "chrom") if size is None else F.concat(F.lit("fixedStep chrom="), "chrom", F.lit(" start="), "p", F.lit(f" span={size} step={step}"))
    lines = body.unionByName(first.select("chrom", F.lit(0).alias("k"), F.lit(0).cast("long").alias("pos"), head.alias("value")))
    if name is not None:
        top = rows.sparkSession.createDataFrame([("", -1, 0, f'track type=wiggle_0 name="{name}" description="{description}"')], "chrom string, k int, pos long, value string")
        lines = lines.unionByName(top)
    return lines.orderBy("chrom", "k", "pos")


def to_bedgraph(rows: DataFrame, size: int | None = None, step: int | None = None) -> DataFrame:
    """Lines of a bedGraph track: chrom start end stat."""
    stats = rows.where(F.col("stat").isNotNull()) if size is None else window_stat(rows, size, step).withColumnRenamed("win_start", "pos")
    line = F.concat_ws(" ", "chrom", F.col("pos").cast("string"), (F.col("pos") + (size or 1)).cast("string"), F.col("stat").cast("string"))
    return stats.select("chrom", "pos", line.alias("value")).orderBy("chrom", "pos")


def r2_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, r2 of all pairs of rows (keys, row_idx, dose) with the same keys: squared correlation of complete pairs, null without variance."""
    one = rows.select(*keys, F.col("row_idx").alias("a"), F.col("dose").alias("x"))
    two = rows.select(*keys, F.col("row_idx").alias("b"), F.col("dose").alias("y"))
    return one.join(two, keys).where("a < b").select(*keys, "a", "b", (correlation("x", "y") * correlation("x", "y")).alias("r2"))


def correlation(x: str, y: str, least: int = 0) -> Column:
    """Pearson's r of two arrays where both are known, by sums of whole numbers; null without variance or below ``least`` pairs."""
    both = F.filter(F.zip_with(x, y, lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    total = lambda f: F.aggregate(both, F.lit(0).cast("long"), lambda acc, p: acc + f(p))
    n = F.size(both)
    sx, sy, sxx, syy, sxy = total(lambda p: p["a"]), total(lambda p: p["b"]), total(lambda p: p["a"] * p["a"]), total(lambda p: p["b"] * p["b"]), total(lambda p: p["a"] * p["b"])
    spread = ((n * sxx - sx * sx) * (n * syy - sy * sy)).cast("double")
    r = (n * sxy - sx * sy) / F.sqrt(F.when(spread > 0, spread))
    return F.when(n >= least, r) if least else r


def calc_r2_windows(v: Variations, size: int, step: int | None = None) -> DataFrame:
    """chrom, win_start, r2: the mean of r2 over the pairs of variants in (start, start + size]; null without pairs."""
    rows = v.df.select("row_idx", "chrom", "pos", g.dosages(F.col("calls")).alias("dose"))
    rows = window_explode(rows, size, step, after_start=True, to_last=False)
    pairs = r2_pairs(rows, ["chrom", "win_start"]).groupBy("chrom", "win_start").agg(F.avg("r2").alias("r2"))
    there = rows.select("chrom", "win_start").distinct()
    return there.join(pairs, ["chrom", "win_start"], "left")


def diversity_windows(v: Variations, size: int, max_num_alleles: int | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """chrom, win_start, s, theta, pi of tumbling windows, per base: segregating sites, Watterson's estimate, mean expected heterozygosity."""
    calls = F.col("calls")
    counts = g.allele_counts(calls)
    n = len(v.samples) * v.ploidy
    harmonic = sum(1 / i for i in range(1, n))
    rows = v.df.select("chrom", "pos", F.size(counts).alias("k"), g.unbiased_het(calls, v.ploidy, min_num_genotypes).alias("h"))
    if max_num_alleles:
        rows = rows.where(F.col("k") <= max_num_alleles)
    rows = window_explode(rows, size).groupBy("chrom", "win_start").agg((F.count_if(F.col("k") > 1) / size).alias("s"), (F.sum("h") / size).alias("pi"))
    return rows.select("chrom", "win_start", "s", (F.col("s") / harmonic).alias("theta"), "pi")
