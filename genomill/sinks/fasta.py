"""Sequences of haplotypes as FASTA."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import bound
from ..operators.filters import IndelFilter
from ..operators.table import Variations


#: Numbers of variants whose letters are joined before they go to their sequences.
BLOCK = 1_024


class AlignmentTooDifficultError(ValueError):
    pass


def pairwise(short: str, long: str) -> str:
    """The short one with gaps, so that most of its letters meet equal ones of the long one; gaps as late as possible."""
    n, m = len(short), len(long)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j + 1] + (short[i] == long[j]), best[i][j + 1])
    out, i = [], 0
    for j in range(m):
        left = m - j
        if i < n and (n - i == left or best[i + 1][j + 1] + (short[i] == long[j]) >= best[i][j + 1]):
            out.append(short[i])
            i += 1
        else:
            out.append("-")
    return "".join(out)


def fix_lengths(alleles: list[str], align: bool, hyphens: bool) -> list[str]:
    """Alleles of one length: as they are, padded if of one and two letters, or aligned where that is easy."""
    lengths = {len(a) for a in alleles}
    if len(lengths) == 1 or not hyphens:
        return alleles
    if lengths == {1, 2}:
        return [a.ljust(2, "-") for a in alleles]
    if not align:
        raise AlignmentTooDifficultError("alleles of several lengths")
    longest = max(alleles, key=len)
    done = [pairwise(a, longest) for a in alleles]
    for column in zip(*done, strict=True):
        if len({c for c in column if c != "-"}) > 1:
            raise AlignmentTooDifficultError("alleles that differ inside an indel")
    return done


def one_length(alleles: Column, align: bool = True, hyphens: bool = True) -> Column:
    """Alleles of one length, null where they can't be aligned; only variants with several lengths go to Python, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def fixed(several: pd.Series) -> pd.Series:
        def one(alleles):
            try:
                return None if alleles is None else fix_lengths(list(alleles), align, hyphens)
            except AlignmentTooDifficultError:
                return None

        return several.map(one)

    same = F.size(F.array_distinct(F.transform(alleles, lambda a: F.length(a)))) == 1
    return F.when(same, alleles).otherwise(fixed(F.when(~same, alleles)))


def sequences(v: Variations, remove_indels: bool = True, one_per_sample: bool = False, remove_invariant_snps: bool = False, remove_sites_all_N: bool = True, try_to_align_easy_indels: bool = False, put_hyphens_in_indels: bool = True) -> DataFrame:
    """sample_idx, hap, name, sequence. ``one_per_sample``: one sequence for each sample, N where it is heterozygous."""
    if not remove_indels and try_to_align_easy_indels != put_hyphens_in_indels:
        raise ValueError("aligning indels and hyphens in them go together")
    if remove_indels:
        v = IndelFilter()(v).kept
    if one_per_sample and v.ploidy != 2:
        raise NotImplementedError("one sequence for each sample only of diploids")
    haps = F.transform("calls", lambda c: F.array(F.when(c["gt"][0] == c["gt"][1], c["gt"][0])) if one_per_sample else c["gt"])
    every = F.concat(F.array("ref"), F.coalesce(F.array_compact("alt"), F.array().cast("array<string>")))
    df = v.df.select("row_idx", "chrom", "pos", every.alias("alleles"), haps.alias("haps"))
    flat = F.filter(F.flatten("haps"), lambda a: a.isNotNull())
    if remove_invariant_snps:
        df = df.where(F.size(F.array_distinct(flat)) > 1)
    if remove_sites_all_N:  # as many missing alleles as samples are enough
        df = df.where(F.size("haps") > F.size(F.filter(F.flatten("haps"), lambda a: a.isNull())))
    hyphens, align = put_hyphens_in_indels, try_to_align_easy_indels

    df = df.withColumn("letters", one_length(F.col("alleles"), align, hyphens)).where("letters is not null")
    widest = F.array_max(F.transform("letters", lambda a: F.length(a)))
    # A variant's letters for all haplotypes at once: as rows they would be as many as calls.
    n_haps = 1 if one_per_sample else v.ploidy
    n = len(v.samples) * n_haps
    places = F.slice(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), 1, n)
    # Each is bound: Catalyst would put its expression into the function, where it is worked out again for every haplotype.
    named = {"letters": F.col("letters"), "missing": F.repeat(F.lit("N"), widest)}
    given = lambda s, a: F.coalesce(F.get(s["letters"], a), s["missing"])
    several = lambda s, gt: F.transform(F.sequence(F.lit(0), F.lit(n_haps - 1)), lambda h: given(s, F.get(gt, h)))
    of_all = bound(named, lambda s: F.flatten(F.transform("haps", lambda gt: several(s, gt))))
    pieces = df.select("row_idx", of_all.alias("x")).groupBy(F.floor(F.col("row_idx") / BLOCK).alias("block")).agg(F.collect_list(F.struct("row_idx", "x")).alias("rows"))
    texts = bound({"rows": F.transform(F.array_sort("rows"), lambda r: r["x"])}, lambda s: F.transform(places, lambda i: F.array_join(F.transform(s["rows"], lambda x: F.get(x, i)), "")))
    pieces = pieces.select("block", F.posexplode(texts).alias("place", "piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda s: s["piece"]), "")
    seqs = pieces.groupBy("place").agg(whole.alias("sequence")).select(F.floor(F.col("place") / n_haps).cast("int").alias("sample_idx"), (F.col("place") % n_haps).alias("hap"), "sequence")
    name = F.get(F.array(*[F.lit(s) for s in v.samples]), F.col("sample_idx"))
    return seqs.select("sample_idx", "hap", (name if one_per_sample else F.concat(name, F.lit("_hap"), (F.col("hap") + 1).cast("string"))).alias("name"), "sequence")


def description(v: Variations) -> str:
    """Where the table begins and ends, and what it covers if that is one chromosome."""
    ends = v.df.agg(F.min_by(F.struct("chrom", "pos"), "row_idx").alias("a"), F.max_by(F.struct("chrom", "pos"), "row_idx").alias("b")).first()
    if ends.a is None:
        return ""
    text = f" From {ends.a.chrom}:{ends.a.pos} to {ends.b.chrom}:{ends.b.pos}"
    return text + (f" length covered:{ends.b.pos - ends.a.pos}" if ends.a.chrom == ends.b.chrom else "")


def write_fasta(v: Variations, path: str, **options) -> None:
    about = description(v)
    rows = sequences(v, **options)
    order = F.row_number().over(Window.orderBy("sample_idx", "hap"))
    rows.select(order.alias("o"), F.concat(F.lit(">"), "name", F.lit(about + "\n"), "sequence").alias("value")).orderBy("o").select("value").write.text(path)
