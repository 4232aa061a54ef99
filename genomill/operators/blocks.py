"""Haplotype blocks: runs of variants whose dosages agree with the block's first, and their grouping into one record.

Where a block ends decides where the next begins, so chromosomes are scanned in order, one task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from .table import Variations

BLOCK = "chrom string, start long, stop long, start_idx long, stop_idx long"


def correlated(ref: np.ndarray, dose: np.ndarray, difference_rate_allowed: float, min_num_gts_compared: int) -> tuple[bool, bool]:
    """(whether two variants agree, or agree when 0 and 2 are swapped; whether enough genotypes are called in both). Missing is -1."""
    both = (ref >= 0) & (dose >= 0)
    n = int(both.sum())
    if n < min_num_gts_compared:
        return False, False
    a, b = ref[both], dose[both]
    best = max(int((a == b).sum()), int((a == 2 - b).sum()))
    return best / n > 1 - difference_rate_allowed, True


def scan(dose: np.ndarray, difference_rate_allowed: float = 0.05, min_num_gts_compared: int = 10, max_missing_rate_in_ref_snp: float = 0.9) -> Iterator[tuple[int, int]]:
    """[start, stop) of blocks. Variants without information don't end a block, but a block doesn't end in them."""
    n, at = len(dose), 0
    while at < n:
        while at < n and (dose[at] < 0).mean() >= max_missing_rate_in_ref_snp:
            at += 1
        if at >= n:
            return
        last, j = at, at + 1
        while j < n:
            agrees, known = correlated(dose[at], dose[j], difference_rate_allowed, min_num_gts_compared)
            if known and not agrees:
                break
            if known:
                last = j
            j += 1
        yield at, last + 1
        at = last + 1


def generate_blocks(v: Variations, difference_rate_allowed: float = 0.05, min_num_gts_compared: int = 10, max_missing_rate_in_ref_snp: float = 0.9) -> DataFrame:
    """chrom, start, stop (one after the last position), start_idx, stop_idx."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        dose = np.array([[-1 if d is None or d != d else d for d in row] for row in pdf["dose"]], dtype=np.int64).reshape(len(pdf), -1)
        pos, idx = pdf["pos"].to_numpy(), pdf["row_idx"].to_numpy()
        rows = [(pdf["chrom"].iloc[0], pos[a], pos[b - 1] + 1, idx[a], idx[b - 1] + 1) for a, b in scan(dose, difference_rate_allowed, min_num_gts_compared, max_missing_rate_in_ref_snp)]
        return pd.DataFrame(rows, columns=["chrom", "start", "stop", "start_idx", "stop_idx"])

    rows = v.df.select("row_idx", "chrom", F.col("pos").cast("long").alias("pos"), g.dosages(F.col("calls")).alias("dose"))
    return rows.groupBy("chrom").applyInPandas(one, BLOCK)


def group_variations(v: Variations, blocks: DataFrame, min_num_vars_in_block: int = 1, remove_snps_with_hets_or_missing: bool = False, variations_are_phased: bool = False) -> DataFrame:
    """chrom, pos, ref, alt, sn, aa, gts: a record for each block.

    A haplotype is an allele; they are numbered as they first appear by sample and haplotype, the
    reference's is 0. aa holds all alleles, padded with hyphens to one length at each variant.
    Missing genotypes, and heterozygous ones unless phased, are an error or their variants are left out.
    """
    df = v.df
    good = F.forall("calls", lambda c: g.is_hom(c["gt"]))
    if remove_snps_with_hets_or_missing:
        df = df.where(good)
    else:
        ok = F.forall("calls", lambda c: ~g.is_missing(c["gt"])) if variations_are_phased else good
        df = df.where(F.when(~ok, F.raise_error(F.lit("missing or heterozygous genotypes in a block")).cast("boolean")).otherwise(True))
    b = blocks.select(F.col("chrom").alias("_chrom"), "start_idx", "stop_idx")
    inside = (F.col("chrom") == F.col("_chrom")) & (F.col("row_idx") >= F.col("start_idx")) & (F.col("row_idx") < F.col("stop_idx"))
    every = F.concat(F.array("ref"), F.coalesce("alt", F.array().cast("array<string>")))
    rows = df.join(b, inside).select("chrom", "start_idx", F.struct("row_idx", F.col("pos").cast("long").alias("pos"), every.alias("alleles"), F.transform("calls", lambda c: c["gt"]).alias("gts")).alias("x"))
    grouped = rows.groupBy("chrom", "start_idx").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") >= min_num_vars_in_block)
    schema = "chrom string, pos long, ref string, alt array<string>, sn int, aa array<string>, gts array<array<int>>"

    def records(batches):
        for pdf in batches:
            yield pd.DataFrame([_record(c, xs) for c, xs in zip(pdf["chrom"], pdf["xs"], strict=True)], columns=["chrom", "pos", "ref", "alt", "sn", "aa", "gts"])

    return grouped.select("chrom", "xs").mapInPandas(records, schema)


def _record(chrom: str, xs) -> tuple:
    n_samples = len(xs[0]["gts"])
    alleles = {(0,) * len(xs): 0}
    gts = []
    for s in range(n_samples):
        haps = zip(*[[int(a) for a in x["gts"][s]] for x in xs], strict=True)
        gts.append([alleles.setdefault(h, len(alleles)) for h in haps])
    widths = [max(map(len, x["alleles"])) for x in xs]
    aligned = ["".join(x["alleles"][a].ljust(w, "-") for x, a, w in zip(xs, h, widths, strict=True)) for h in alleles]
    plain = [a.replace("-", "") for a in aligned]
    return chrom, int(xs[0]["pos"]), plain[0], plain[1:], len(xs), aligned, gts
