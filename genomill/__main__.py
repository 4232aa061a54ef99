"""python -m genomill load|load-matrix|merge|report ...: the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import genotype as g
from .operators import histograms, merge, populations, samples, variant_stats, windows
from .operators.table import Variations
from .sources import matrix_text, vcf


def report(v: Variations, out: str, window: int) -> None:
    """The tables of a quality report, a folder each."""
    tables = {
        "maf": histograms.histogram_for_stat(v, variant_stats.calc_maf), "missing": histograms.histogram_for_stat(v, variant_stats.calc_missing_gt), "obs_het": histograms.histogram_for_stat(v, variant_stats.calc_obs_het),
        "density": windows.calc_snp_density(v, window), "samples": samples.stats_table(v), "gt_types": samples.calc_gt_type_stats(v), "hwe": variant_stats.calc_hwe_chi2_test(v), "diversity": windows.diversity_windows(v, window),
        "inbreeding": histograms.histogram_for_stat(v, variant_stats.calc_inbreeding_coef), "called_by_depth": histograms.called_by_depth(v, [5, 10, 20]), "depth_by_type": samples.depth_histograms_by_sample(v), "maf_depth": histograms.maf_depth_histograms(v),
        "allele_observations": histograms.hist2d_allele_observations(v), "r2": windows.calc_r2_windows(v, window),
        "maf_by_depth": histograms.histogram_for_stat(v, variant_stats.calc_allele_observation_based_maf), "gq_observations": histograms.hist2d_gq_allele_observations(v),
        "gq_of_hom": histograms.field_histogram(v, "gq", mask=g.is_hom), "gq_of_het": histograms.field_histogram(v, "gq", mask=g.is_het),
        "het_allele_freq": histograms.hist2d_het_allele_freq(v),
    }
    if v.populations:
        tables["populations"] = populations.pop_stats_report(v)
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{out}/{name}", header=True)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="genomill")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("load", help="VCF into a store")
    one.add_argument("vcf")
    one.add_argument("store")
    one.add_argument("--kept-fields", nargs="*")
    one.add_argument("--ignored-fields", nargs="*")
    one = commands.add_parser("load-matrix", help="genotype matrix into a store")
    one.add_argument("matrix")
    one.add_argument("var_info", help="CSV with id,chrom,pos")
    one.add_argument("store")
    one.add_argument("--coding", choices=sorted(matrix_text.SPLITTERS), default="two_letters")
    one.add_argument("--sep", default=",")
    one = commands.add_parser("merge", help="two stores into one")
    one.add_argument("store1")
    one.add_argument("store2")
    one.add_argument("out")
    one.add_argument("--ignore-complex", action="store_true")
    one.add_argument("--any-reference", action="store_true", help="don't compare the references of both")
    one = commands.add_parser("report", help="quality report of a store")
    one.add_argument("store")
    one.add_argument("out")
    one.add_argument("--window", type=int, default=10_000)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("genomill").getOrCreate()
    if a.command == "load":
        vcf.vcf_to_store(spark, a.vcf, a.store, kept_fields=a.kept_fields, ignored_fields=a.ignored_fields)
    elif a.command == "load-matrix":
        info = spark.read.csv(a.var_info, header=True, schema="id string, chrom string, pos int")
        matrix_text.read_matrix(spark, a.matrix, info, matrix_text.SPLITTERS[a.coding], sep=a.sep).write(a.store)
    elif a.command == "merge":
        merge.merge(Variations.read(spark, a.store1), Variations.read(spark, a.store2), ignore_complex_overlaps=a.ignore_complex, check_ref_matches=not a.any_reference).write(a.out)
    else:
        report(Variations.read(spark, a.store), a.out, a.window)


if __name__ == "__main__":
    main()
