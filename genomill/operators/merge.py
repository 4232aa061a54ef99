"""Full outer join of two variant tables by overlap, with alleles numbered anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BLOCK
from .table import Variations


class MalformedVariationError(ValueError):
    pass


def overlap_groups(*sides: DataFrame) -> DataFrame:
    """The rows of all sides with side (from 1) and group: rows whose [pos, pos + longest allele) overlap share one.

    A row begins a group if it starts beyond the end of all before it.
    """
    rows = None
    for i, df in enumerate(sides, 1):
        longest = F.greatest(F.length("ref"), F.coalesce(F.array_max(F.transform("alt", lambda a: F.length(a))), F.lit(0)))
        one = df.select(F.lit(i).alias("side"), "chrom", F.col("pos").cast("long").alias("pos"), "ref", "alt", "qual", F.transform("calls", lambda c: c["gt"]).alias("gts"), (F.col("pos") + longest - 1).cast("long").alias("end"))
        rows = one if rows is None else rows.unionByName(one)
    # Blocks of positions go through by themselves: what reaches into a block from those before it, and how many groups
    # begin before it, are a row for each block.
    rows = rows.withColumn("_block", F.floor(F.col("pos") / BLOCK))
    order = Window.partitionBy("chrom", "_block").orderBy("pos", F.col("side").desc())
    past = Window.partitionBy("chrom").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    reaches = rows.groupBy("chrom", "_block").agg(F.max("end").alias("_end")).select("chrom", "_block", F.max("_end").over(past).alias("_reach"))
    reach = F.greatest(F.col("_reach"), F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(F.broadcast(reaches), ["chrom", "_block"]).withColumn("new", F.coalesce((F.col("pos") > reach).cast("int"), F.lit(1)))
    begun = rows.groupBy("chrom", "_block").agg(F.sum("new").alias("_n")).select("chrom", "_block", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    number = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    return rows.join(F.broadcast(begun), ["chrom", "_block"]).withColumn("group", number).drop("new", "_block", "_reach", "_before")


def group_counts(one: DataFrame, two: DataFrame) -> DataFrame:
    """chrom, group, n1, n2."""
    return overlap_groups(one, two).groupBy("chrom", "group").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))


def _alleles(s: Column) -> Column:
    return F.concat(F.array(s["ref"]), F.coalesce(F.filter(s["alt"], lambda a: a != ""), F.array().cast("array<string>")))


def merge(one: Variations, two: Variations, suffix_for_sample2: str | None = None, ignore_complex_overlaps: bool = False, ignore_malformed_vars: bool = False, check_ref_matches: bool = True, ignore_non_matching: bool = False, merge_only_snps: bool = False) -> Variations:
    """The variants of both, with the calls of both: REF is the longer reference, the shorter alleles are spliced into it.

    Groups of more than one variant of a side, or of two longer than one base, are complex: an error,
    or left out with ``ignore_complex_overlaps``. A shorter variant that begins before the longer one
    is malformed. Quality is the smaller of both, null if either is. ``ignore_non_matching`` keeps
    only variants of both sides.
    """
    names = [f"{s}{suffix_for_sample2}" if suffix_for_sample2 else s for s in two.samples]
    if set(names) & set(one.samples):
        raise ValueError("samples of the same name; give a suffix")
    item = F.struct("side", "pos", "ref", "alt", "qual", "gts", (F.col("end") - F.col("pos") + 1).alias("len"))
    g = overlap_groups(one.df, two.df).groupBy("chrom", "group").agg(F.collect_list(F.when(F.col("side") == 1, item)).alias("s1"), F.collect_list(F.when(F.col("side") == 2, item)).alias("s2"))
    a, b = F.get("s1", F.lit(0)), F.get("s2", F.lit(0))
    g = g.withColumn("a", a).withColumn("b", b)
    long_one = F.coalesce(F.col("a.len") > 1, F.lit(False)) & F.coalesce(F.col("b.len") > 1, F.lit(False))
    complex_ = (F.size("s1") > 1) | (F.size("s2") > 1) | long_one
    if merge_only_snps:
        complex_ = complex_ | F.coalesce(F.col("a.len") > 1, F.lit(False)) | F.coalesce(F.col("b.len") > 1, F.lit(False))
    fail = lambda text: F.raise_error(F.concat(F.lit(text), "chrom", F.lit(":"), F.coalesce("a.pos", "b.pos").cast("string")))
    if ignore_complex_overlaps:
        g = g.where(~complex_)
    else:
        g = g.where(F.when(complex_, fail("variants that can't be merged at ").cast("boolean")).otherwise(True))
    if ignore_non_matching:
        g = g.where(F.col("a").isNotNull() & F.col("b").isNotNull())

    first_long = F.length("a.ref") >= F.length("b.ref")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    g = g.withColumn("both", both).withColumn("first_long", first_long).withColumn("l", F.when(~both, F.coalesce("a", "b")).when(first_long, F.col("a")).otherwise(F.col("b"))).withColumn("s", F.when(both, F.when(first_long, F.col("b")).otherwise(F.col("a"))))
    at = F.col("s.pos") - F.col("l.pos")
    malformed = F.col("both") & ((at < 0) | (at >= F.length("l.ref")))
    if ignore_malformed_vars:
        g = g.where(~malformed)
    else:
        g = g.where(F.when(malformed, fail("malformed variants at ").cast("boolean")).otherwise(True))
    splice = lambda x: F.concat(F.substring("l.ref", F.lit(1), at.cast("int")), x, F.substring("l.ref", (at + 2).cast("int"), F.length("l.ref")))
    g = g.withColumn("short", F.when(F.col("both"), F.transform(_alleles(F.col("s")), splice)))
    if check_ref_matches:
        g = g.where(F.when(F.col("both") & (F.col("short")[0] != F.col("l.ref")), fail("references that differ at ").cast("boolean")).otherwise(True))
    own = _alleles(F.col("l"))
    g = g.withColumn("alleles", F.when(F.col("both"), F.array_union(own, "short")).otherwise(own))
    number = lambda i: F.when(i.isNotNull(), (F.array_position("alleles", F.get("short", i)) - 1).cast("int"))
    short_gts = F.transform("s.gts", lambda gt: F.transform(gt, number))
    none = lambda n, k: F.array(*[F.array(*[F.lit(None).cast("int")] * k)] * n)
    no1, no2 = none(len(one.samples), one.ploidy), none(len(two.samples), two.ploidy)
    gts1 = F.when(F.col("a").isNull(), no1).when(F.col("both") & ~F.col("first_long"), short_gts).otherwise(F.col("a.gts"))
    gts2 = F.when(F.col("b").isNull(), no2).when(F.col("both") & F.col("first_long"), short_gts).otherwise(F.col("b.gts"))
    qual = F.when(~F.col("both"), F.col("l.qual")).when(F.col("a.qual").isNotNull() & F.col("b.qual").isNotNull(), F.least("a.qual", "b.qual"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("dp", "int"), ("gq", "int"), ("ro", "int"), ("ao", "array<int>"), ("ad", "array<int>"))]
    calls = F.transform(F.concat(gts1, gts2), lambda gt: F.struct(gt.alias("gt"), *nothing))
    rest = F.slice("alleles", F.lit(2), F.size("alleles"))
    rows = g.select("chrom", F.col("l.pos").cast("int").alias("pos"), F.lit(None).cast("string").alias("id"), F.col("alleles")[0].alias("ref"), F.when(F.size("alleles") > 1, rest).alias("alt"), qual.alias("qual"), calls.alias("calls"))
    from .ordering import sort_variations

    out = Variations(rows.withColumn("row_idx", F.monotonically_increasing_id()), [*one.samples, *names], one.ploidy)
    return sort_variations(out)
