"""SAM text as k-mer loci: the k-mers of aligned reads at each place, by sample, and alleles inferred from their counts."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import yates

_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
COUNTS = "ref string, pos long, sample string, kmer string, n long"


def aligned_kmers(pos: int, cigar: str, seq: str, k: int) -> list[tuple[int, str]]:
    """(0-based place, k-mer) of each aligned base; k-mers that the read is too short for are left out."""
    out, at, q = [], pos - 1, 0
    for n, op in _CIGAR.findall(cigar):
        n = int(n)
        if op in "M=X":
            out += [(at + i, seq[q + i : q + i + k]) for i in range(n) if q + i + k <= len(seq)]
            at, q = at + n, q + n
        elif op in "IS":
            q += n
        elif op in "DN":
            at += n
    return out


def read_kmers(spark: SparkSession, paths: list[str], k: int, step: int = 1, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """ref, pos, sample, kmer, n of all files together; a read without a known read group has a null sample.

    ``regions``: only places of (ref, start, stop), from 0, the stop not included.
    """
    text = spark.read.text(paths).withColumn("file", F.input_file_name())
    heads = text.where(F.col("value").startswith("@")).collect()
    groups: dict[tuple[str, str], str] = {}
    references: dict[str, list] = {}
    for r in heads:
        fields = dict(x.split(":", 1) for x in r.value.split("\t")[1:] if ":" in x)
        if r.value.startswith("@RG"):
            groups[r.file, fields["ID"]] = fields.get("SM")
        elif r.value.startswith("@SQ"):
            references.setdefault(r.file, []).append((fields["SN"], fields.get("LN")))
    if len({tuple(x) for x in references.values()}) > 1:
        raise ValueError("the files have different references")

    def run(batches):
        for pdf in batches:
            count: Counter = Counter()
            for line, file in zip(pdf["value"], pdf["file"], strict=True):
                f = line.split("\t")
                if len(f) < 11 or f[2] == "*" or int(f[1]) & 4:
                    continue
                group = next((x[5:] for x in f[11:] if x.startswith("RG:Z:")), None)
                sample = groups.get((file, group))
                count.update((f[2], at, sample, kmer) for at, kmer in aligned_kmers(int(f[3]), f[5], f[9], k))
            yield pd.DataFrame([(*key, n) for key, n in count.items()], columns=["ref", "pos", "sample", "kmer", "n"])

    kmers = text.where(~F.col("value").startswith("@")).select("value", "file").mapInPandas(run, COUNTS)
    return counted(kmers, step, regions)


def counted(kmers: DataFrame, step: int = 1, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """The sums of what tasks counted, at every ``step``-th place, and of some regions only."""
    if regions is not None:
        inside = F.lit(False)
        for ref, start, stop in regions:
            inside = inside | ((F.col("ref") == ref) & (F.col("pos") >= start) & (F.col("pos") < stop))
        kmers = kmers.where(inside)
    return kmers.where(F.col("pos") % step == 0).groupBy("ref", "pos", "sample", "kmer").agg(F.sum("n").alias("n"))


def covered(kmers: DataFrame, min_sample_coverage: int = 0, min_num_samples: int = 0) -> DataFrame:
    """Only samples of a locus with enough k-mers, and loci with enough such samples."""
    by = kmers.groupBy("ref", "pos", "sample").agg(F.sum("n").alias("all")).where(F.col("all") >= min_sample_coverage)
    loci = by.groupBy("ref", "pos").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_num_samples).select("ref", "pos")
    good = by.join(loci, ["ref", "pos"]).select("ref", "pos", F.col("sample").alias("_s"))
    same = (kmers["ref"] == good["ref"]) & (kmers["pos"] == good["pos"]) & kmers["sample"].eqNullSafe(good["_s"])
    return kmers.join(good, same, "left_semi")


def infer_alleles(counts: dict[str, int], ploidy: int = 2, edit_distance_fix: int = 1, min_coverage_to_be_template_for_fix: int = 3, low_freq_allele_filter_pvalue: float = 0.05) -> dict[str, int]:
    """The alleles of a sample at a locus: its most frequent k-mers, with the counts of their single misreadings.

    A rarer k-mer within the Hamming distance of exactly one template allele adds to it. Of two
    alleles in unlikely shares only the more frequent stays.
    """
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    alleles, others = dict(ranked[:ploidy]), dict(ranked[ploidy:])
    templates = [a for a, n in alleles.items() if n >= min_coverage_to_be_template_for_fix]
    for kmer, n in others.items():
        near = [a for a in templates if sum(x != y for x, y in zip(a, kmer, strict=False)) <= edit_distance_fix]
        if len(near) == 1:
            alleles[near[0]] += n
    if len(alleles) == 2 and ploidy == 2 and yates(*alleles.values()) < low_freq_allele_filter_pvalue:
        best = max(alleles, key=lambda a: (alleles[a], a))
        alleles = {best: alleles[best]}
    return alleles


def genotypes(kmers: DataFrame, ploidy: int = 2, **options) -> DataFrame:
    """ref, pos, sample, alleles (k-mers, a homozygote's once for each chromosome), ad; a locus and sample at a time."""
    if ploidy != 2:
        raise NotImplementedError("only for diploids")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = infer_alleles(dict(zip(pdf["kmer"], pdf["n"].astype(int), strict=True)), ploidy, **options)
        names = sorted(found, key=lambda a: (-found[a], a))
        gt = names * ploidy if len(names) == 1 else names
        return pd.DataFrame([(pdf["ref"].iloc[0], pdf["pos"].iloc[0], pdf["sample"].iloc[0], gt[:ploidy], [found[a] for a in names])], columns=["ref", "pos", "sample", "alleles", "ad"])

    return kmers.groupBy("ref", "pos", "sample").applyInPandas(one, "ref string, pos long, sample string, alleles array<string>, ad array<long>")
