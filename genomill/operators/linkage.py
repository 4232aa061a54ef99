"""Linkage between variants: range self-joins over positions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from .table import Variations
from .windows import correlation

MAX_MAF = 0.95


def range_self_join(df: DataFrame, max_dist: int, key: str = "chrom", pos: str = "pos") -> DataFrame:
    """Pairs (a_*, b_*) of rows of a key with b after a (by pos, then row_idx) and at most ``max_dist`` apart.

    Positions fall into bins as wide as the distance, so that a row only meets its own bin and the
    next one: an equi-join whose work follows the density, not the square of a chromosome.
    """
    width = max(int(max_dist), 1)
    bins = df.withColumn("_bin", F.floor(F.col(pos) / width))
    one = bins.select(*[F.col(c).alias(f"a_{c}") for c in df.columns], F.explode(F.array(F.col("_bin"), F.col("_bin") + 1)).alias("_bin"))
    two = bins.select(*[F.col(c).alias(f"b_{c}") for c in df.columns], "_bin")
    gap = F.col(f"b_{pos}").cast("long") - F.col(f"a_{pos}").cast("long")
    later = (gap > 0) | ((gap == 0) & (F.col("b_row_idx") > F.col("a_row_idx")))
    pairs = one.join(two, (one["_bin"] == two["_bin"]) & (F.col(f"a_{key}") == F.col(f"b_{key}")))
    return pairs.where(later & (gap <= max_dist)).drop("_bin")


def iterate_pairs(v: Variations, max_dist: int) -> DataFrame:
    """row_idx pairs (a, b) of a chromosome at most ``max_dist`` apart."""
    pairs = range_self_join(v.df.select("row_idx", "chrom", "pos"), max_dist)
    return pairs.select(F.col("a_row_idx").alias("a"), F.col("b_row_idx").alias("b"), (F.col("b_pos") - F.col("a_pos")).alias("dist"))


def rogers_huff_r(x: str, y: str, least: int = g.MIN_GENOTYPES) -> Column:
    """Absolute correlation of dosages where both are known."""
    return F.abs(correlation(x, y, least))


def check_maf(v: Variations, max_maf: float = MAX_MAF) -> None:
    """Linkage is refused if any variant has no major allele frequency or one above ``max_maf``."""
    maf = g.major_frequency(F.col("calls"), 0)
    if not v.df.where(maf.isNull() | (maf > max_maf)).isEmpty():
        raise ValueError(f"variants without, or with a major allele frequency above {max_maf}: filter them first")


def calc_ld_along_genome(v: Variations, max_dist: int, min_num_gts: int = g.MIN_GENOTYPES, max_maf: float | None = MAX_MAF) -> DataFrame:
    """a, b, chrom, pos_a, pos_b, dist, r: each pair of variants once; r is null with too few genotypes or no variance."""
    if max_maf is not None:
        check_maf(v, max_maf)
    pairs = range_self_join(v.df.select("row_idx", "chrom", "pos", g.dosages(F.col("calls")).alias("dose")), max_dist)
    return pairs.select(F.col("a_row_idx").alias("a"), F.col("b_row_idx").alias("b"), F.col("a_chrom").alias("chrom"), F.col("a_pos").alias("pos_a"), F.col("b_pos").alias("pos_b"), (F.col("b_pos") - F.col("a_pos")).alias("dist"), rogers_huff_r("a_dose", "b_dose", min_num_gts).alias("r"))


def calc_ld_random_pairs_from_different_chroms(v: Variations, num_pairs: int, max_maf: float | None = MAX_MAF, min_num_gts: int = g.MIN_GENOTYPES, seed: int = 0) -> DataFrame:
    """a, b, r (signed) of random pairs of variants of different chromosomes; pairs of undefined r are left out."""
    if max_maf is not None:
        check_maf(v, max_maf)
    sizes = v.df.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).orderBy("chrom").collect()
    if len(sizes) < 2:
        raise ValueError("one chromosome only")
    # Places to draw: chromosomes by size, then places within; only the drawn rows are joined.
    draw = random.Random(seed)
    starts, n = {}, 0
    for r in sizes:
        starts[r.chrom] = n
        n += r.n
    of = [(starts[r.chrom], starts[r.chrom] + r.n) for r in sizes]
    pairs = []
    while len(pairs) < num_pairs:
        (a0, a1), (b0, b1) = draw.sample(of, 2)
        pairs.append((draw.randrange(a0, a1), draw.randrange(b0, b1)))
    from .ordering import sort_variations

    placed = sort_variations(v).df.select(F.col("row_idx").alias("place"), "id", F.transform("calls", lambda c: c["gt"][0]).alias("hap"))
    spark = v.df.sparkSession
    drawn = spark.createDataFrame(pairs, "a long, b long")
    rows = drawn.join(placed.toDF("a", "id_a", "x"), "a").join(placed.toDF("b", "id_b", "y"), "b")
    return rows.select("a", "b", correlation("x", "y", min_num_gts).alias("r")).where("r is not null")


def pairwise_ld(v: Variations) -> DataFrame:
    """a, b, r2 of all pairs of the (few) variants of a table, for a heat map: positions don't matter."""
    rows = v.df.select("row_idx", F.lit(1).alias("k"), g.dosages(F.col("calls")).alias("dose"))
    from .windows import r2_pairs

    return r2_pairs(rows, ["k"]).drop("k")
