"""Genotype matrices as text: a line per variant, a column per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import Variations

# One-letter codes of two bases, and the order in which a variant's bases are numbered.
IUPAC = {"A": "AA", "C": "CC", "G": "GG", "T": "TT", "W": "AT", "M": "AC", "R": "AG", "Y": "TC", "K": "TG", "S": "CG"}
ORDER = "ACTG"


def two_letters(gt: Column) -> Column:
    """Alleles of a genotype of one letter each; '-', '.', '--' and nothing are missing, and so are '-' and 'N' as alleles."""
    known = ~F.coalesce(F.trim(gt), F.lit("")).isin("", "-", ".", "--")
    return F.when(known, F.transform(F.filter(F.split(F.trim(gt), ""), lambda a: a != ""), lambda a: F.when(~a.isin("-", "N"), a)))


def iupac(gt: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return two_letters(F.try_element_at(table, F.trim(gt)))


SPLITTERS = {"two_letters": two_letters, "iupac": iupac}


def read_matrix(spark: SparkSession, path: str, var_info: DataFrame, splitter=two_letters, first_sample_column: int = 1, first_gt_column: int = 1, snp_id_column: int = 0, sep: str = ",", ignore_empty_vars: bool = False) -> Variations:
    """A variation table; ``var_info`` (id, chrom, pos) places the variants, others are left out.

    The alleles of a row are numbered A, C, T, G and then by code point, the first of them is REF.
    A row without any called allele is an error unless ``ignore_empty_vars``.
    """
    text = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    header = text.orderBy("_id").first()
    if header is None:
        raise ValueError("empty file")
    samples = [s.strip() for s in header.value.split(sep)][first_sample_column:]
    import re

    f = F.split("value", re.escape(sep))
    rows = text.where((F.col("_id") > header._id) & (F.length(F.trim("value")) > 0)).select("_id", F.trim(F.get(f, F.lit(snp_id_column))).alias("id"), F.transform(F.slice(f, first_gt_column + 1, max(len(samples), 1)), splitter).alias("letters"))
    every = F.array_distinct(F.filter(F.flatten(F.transform("letters", lambda x: F.coalesce(x, F.array().cast("array<string>")))), lambda a: a.isNotNull()))
    known = F.filter(F.array(*[F.lit(x) for x in ORDER]), lambda x: F.array_contains(every, x))
    rows = rows.withColumn("alleles", F.concat(known, F.array_sort(F.array_except(every, F.array(*[F.lit(x) for x in ORDER])))))
    if not ignore_empty_vars and not rows.where(F.size("alleles") == 0).isEmpty():
        raise RuntimeError("a variant has no called allele")
    rows = rows.where(F.size("alleles") > 0)
    ploidy = rows.agg(F.max(F.array_max(F.transform("letters", lambda x: F.size(x))))).first()[0] or 2
    missing = F.array(*[F.lit(None).cast("int")] * ploidy)
    number = lambda a: F.when(a.isNotNull(), (F.array_position("alleles", a) - 1).cast("int"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("dp", "int"), ("gq", "int"), ("ro", "int"), ("ao", "array<int>"), ("ad", "array<int>"))]
    calls = F.transform("letters", lambda x: F.struct(F.coalesce(F.transform(x, number), missing).alias("gt"), *nothing))
    rest = F.slice("alleles", F.lit(2), F.size("alleles"))
    rows = rows.select("_id", "id", F.col("alleles")[0].alias("ref"), F.when(F.size("alleles") > 1, rest).alias("alt"), calls.alias("calls")).join(var_info.select("id", "chrom", F.col("pos").cast("int").alias("pos")), "id")
    from pyspark.sql import Window

    placed = rows.withColumn("row_idx", (F.row_number().over(Window.partitionBy(F.shiftright("_id", 33)).orderBy("_id")) - 1 + F.shiftright("_id", 33) * (1 << 33)).cast("long"))
    return Variations(placed.select("row_idx", "chrom", "pos", "id", "ref", "alt", F.lit(None).cast("double").alias("qual"), "calls"), samples, ploidy)
