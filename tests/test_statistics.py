import math

import pytest

from genomill.functions.special import chi2_tail, contingency, poisson_quantile
from genomill.operators import filters, histograms, ordering, populations, samples, transforms, variant_stats, windows
from helpers import column, table


def test_major_allele(spark):
    v = table(spark, [[(0,), (0,), (0,), (0,)], [(0,), (0,), (1,), (1,)], [(0,), (0,), (0,), (1,)], [(-1,), (-1,), (-1,), (-1,)]])
    assert column(variant_stats.calc_maf(v, 1), "maf") == [1, 0.5, 0.75, None]
    assert column(variant_stats.calc_mac(v, 1), "mac") == [4, 2, 3, None]


def test_partial_calls_count_alleles(spark):
    v = table(spark, [[(0, 0), (1, 1), (0, -1), (-1, -1)]])
    freqs = {r.allele: r.freq for r in variant_stats.calc_allele_freq(v, 0).collect()}
    assert freqs == pytest.approx({0: 0.6, 1: 0.4})
    assert column(variant_stats.calc_called_gt(v, rates=False), "called") == [2]
    assert column(variant_stats.calc_missing_gt(v), "missing") == [0.5]


def test_depth_frequency_and_maf_depth(spark):
    v = table(spark, [[(0, 0), (0, 1)], [(0, 0), (0, 0)]], ad=[[[4, 1], [3, 3]], [None, None]], ro=[[4, 3], [None, None]], ao=[[[1], [3]], [None, None]])
    assert column(variant_stats.calc_allele_observation_based_maf(v), "maf") == [pytest.approx(7 / 11), None]
    rows = variant_stats.calc_maf_depth(v, 5).orderBy("row_idx", "sample_idx").collect()
    assert [r.maf_depth for r in rows] == [0.8, 0.5, None, None]


# Genotypes of which the statistic and its p are known.
HWE_GTS = [(0, 0), (0, 1), (0, 1), (0, 0), (0, 1), (0, 0), (0, 0), (0, 1), (1, 1), (0, 0)]
HWE_CHI2, HWE_P = 12.58253968, 1.85240619e-03


def test_hardy_weinberg(spark):
    one = HWE_GTS
    two = [(b, a) if i % 3 == 1 else (a, b) for i, (a, b) in enumerate(one)]  # the order of alleles does not count
    got = variant_stats.calc_hwe_chi2_test(table(spark, [one, two]), min_num_genotypes=0).collect()
    assert len(got) == 2 and all((r.chi2, r.pvalue) == pytest.approx((HWE_CHI2, HWE_P)) for r in got)
    plain = variant_stats.calc_hwe_chi2_test(table(spark, [one]), min_num_genotypes=0, textbook=True).first()
    assert plain.chi2 == pytest.approx(0.02268, abs=1e-5)


def test_heterozygosity_and_inbreeding(spark):
    v = table(spark, [[(0, 0), (0, 1), (0, 1), (0, 0), (0, 1), (0, 0), (0, 0), (0, 1), (1, 1), (0, 0)]])
    assert column(variant_stats.calc_inbreeding_coef(v, min_num_genotypes=1), "inbreeding") == [pytest.approx(1 - 0.4 / 0.42)]
    w = table(spark, [[(0, 0), (1, 1), (0, 1), (1, 1), (0, 1), (0, 0), (0, 1)]])
    assert column(variant_stats.calc_expected_het(w, 0), "exp_het") == [0.5]
    assert column(variant_stats.calc_unbias_expected_het(w, 0), "exp_het") == [pytest.approx(7 / 13)]


def test_density_and_windows(spark):
    pos = [1, 2, 3, 4, 5, 6, 7, 25, 100, 200, 300, 400, 1, 4]
    chrom = ["1"] * 12 + ["2"] * 2
    v = table(spark, [[(0, 1)]] * 14, chrom=chrom, pos=pos)
    assert column(windows.calc_snp_density(v, 11), "density") == [6, 7, 7, 7, 7, 7, 6, 1, 1, 1, 1, 1, 2, 2]
    stats = v.df.selectExpr("chrom", "pos", "cast(1 as double) as stat")
    got = {(r.chrom, r.win_start): r.stat for r in windows.window_stat(stats, 10).collect()}
    assert got["1", 1] == 0.7 and got["1", 21] == 0.1 and got["1", 31] == 0 and max(s for c, s in got if c == "1") < 400
    lines = [r.value for r in windows.to_bedgraph(stats.where("chrom = '2'")).collect()]
    assert lines == ["2 1 2 1.0", "2 4 5 1.0"]
    wig = [r.value for r in windows.to_wig(stats.where("chrom = '2'")).collect()]
    assert wig == ["variableStep chrom=2", "1 1.0", "4 1.0"]


def test_filters_keep_and_discard(spark):
    gts = [[(0, 0), (0, 1), (-1, -1)], [(0, 0), (0, 0), (0, 0)], [(0, 1), (0, 2), (1, 1)], [(-1, -1)] * 3]
    v = table(spark, gts, qual=[10, 20, 30, 40], alt=[["C"], ["CA"], ["C", "T"], None])
    kept = lambda f: column(f(v).kept.df, "row_idx")
    assert kept(filters.MinCalledGTsFilter(0.6)) == [0, 1, 2]
    f = filters.MafFilter(max_maf=0.9, min_num_genotypes=0)
    assert kept(f) == [0, 2] and column(f(v).discarded.df, "row_idx") == [1, 3]
    assert kept(filters.MafFilter(max_maf=0.9, min_num_genotypes=0, keep_missing=True)) == [0, 2, 3]
    assert kept(filters.SNPQualFilter(20, 30)) == [1, 2]
    assert kept(filters.IndelFilter()) == [0, 2, 3]
    assert kept(filters.NonBiallelicFilter()) == [0]
    assert kept(filters.NonBiallelicFilter(keep_monomorphic=True, reverse=True)) == [2]
    assert kept(filters.VariableAndNotAllMissing()) == [0, 2]
    assert kept(filters.NoMissingGTsFilter()) == [1, 2] and kept(filters.NoMissingGTsOrHetFilter()) == [1]
    assert kept(filters.OrFilter([filters.SNPQualFilter(max_qual=10), filters.SNPPositionFilter([("1", 4, 9)])])) == [0, 3]
    assert tuple(f(v).stats.first()) == (2, 2, 4)
    assert kept(filters.MafFilter(max_maf=0.9, min_num_genotypes=0, samples=["s0"])) == [2]
    assert sum(r.n for r in f(v).histogram.collect()) == 3
    assert filters.VarsSamplingFilter2(2)(v).kept.num_variations() == 2
    assert v.df.columns == filters.FieldValueFilter("pos", 2)(v).kept.df.columns
    with pytest.raises(ValueError):
        filters.SampleFilter(["s0", "s0"])
    assert filters.SampleFilter(["s2", "s0"])(v).samples == ["s0", "s2"]
    assert filters.filter_samples_by_missing_rate(v, min_called_rate=0.6).samples == ["s0", "s1"]


def test_two_sample_sets_and_duplications(spark):
    v = table(spark, [[(0, 0)] * 4 + [(1, 1)] * 4, [(0, 0)] * 8], dp=[[50] * 8, [5] * 8])
    f = filters.Chi2GtFreqs2SampleSetsFilter(["s0", "s1", "s2", "s3"], ["s4", "s5", "s6", "s7"], 0.5)
    assert column(f(v).kept.df, "row_idx") == [1]
    g = filters.PseudoHetDuplicationFilter2([5.0] * 8, 0.1)
    assert column(g(v).kept.df, "row_idx") == [0, 1]
    h = filters.PseudoHetDuplicationFilter([5.0] * 8, 0.1, -1)
    assert column(h(v).kept.df, "row_idx") == [1]


def test_transforms(spark):
    v = table(spark, [[(0, 1), (2, 2)], [(-1, -1), (0, 0)]], dp=[[5, 20], [None, 20]], ref=["A", "C"], alt=[["A", "T"], ["G"]])
    low = transforms.LowDPGTsToMissingSetter(10)(v).df.orderBy("row_idx").collect()
    assert low[0].calls[0].gt == [None, None] and low[0].calls[0].dp is None and low[0].calls[1].gt == [2, 2]
    fixed = transforms.fix_duplicated_alleles(v).df.orderBy("row_idx").first()
    assert fixed.alt == ["T"] and fixed.calls[0].gt == [0, 0] and fixed.calls[1].gt == [1, 1]
    assert column(transforms.is_variable(v), "is_variable") == [1, 0]
    assert column(transforms.gts_as_mat012(v), "dose") == [[2, 0], [None, 0]]
    flips = v.df.selectExpr("row_idx", "row_idx = 0 as flip")
    assert column(transforms.change_strand(v, flips).df, "ref") == ["T", "C"]
    assert transforms.IsVariableAnnotator("var")(v).df.schema["var"].metadata["Type"] == "Integer"


def test_histogram_of_constant_and_percentiles(spark):
    rows = spark.createDataFrame([(float(x),) for x in [1, 1, 2, 3, 4, 5, 6, 7, 8, 9]], "x double")
    hist = histograms.histogram_of(rows, 4, (1, 9))
    assert column(hist, "n", "bin") == [3, 2, 2, 3]
    assert column(histograms.cumulative(hist), "cum", "bin") == [10, 7, 5, 3]
    assert column(histograms.percentiles_of(hist), "value", "share") == [pytest.approx(2), pytest.approx(4), pytest.approx(6 + 2 * 0.05 / 0.3)]
    assert column(histograms.histogram_of(rows.where("x = 1"), 2), "n", "bin") == [0, 2]
    with pytest.raises(ValueError):
        histograms.histogram_of(rows, 2, (0, math.inf))


def test_populations(spark):
    v = table(spark, [[(0, 0), (0, 1), (1, 1), (1, 1), (2, 2)], [(0, 0), (0, 0), (0, 0), (0, 0), (-1, -1)]], samples=list("abcde"), pops={"x": ["a", "b"], "y": ["c", "d", "e"]})
    got = {(r.row_idx, r.pop): r.n_private for r in populations.calc_number_of_private_alleles(v, min_num_genotypes=0).collect()}
    assert got == {(0, "x"): 1, (0, "y"): 1, (1, "x"): 0, (1, "y"): 0}
    got = {(r.row_idx, r.pop): r.n_alleles for r in populations.calc_number_of_alleles(v, min_num_genotypes=3).collect()}
    assert got == {(0, "x"): 0, (0, "y"): 2, (1, "x"): 0, (1, "y"): 0}
    assert populations.pop_stats_report(v, min_num_genotypes=0, min_call_dp=0).count() == 10


def test_samples(spark):
    v = table(spark, [[(0, 0), (0, 1)], [(1, 1), (-1, -1)]], dp=[[10, 20], [30, None]])
    rows = samples.calc_gt_type_stats(v).orderBy("sample_idx").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, 0, 1, 0), (0, 1, 0, 1)]
    assert column(samples.calc_depth_mean_by_sample(v), "dp_mean", "sample_idx") == [20, 20]
    assert column(samples.calc_depth_mean_by_sample(v, compat=True), "dp_mean", "sample_idx") == [20, 9.5]
    assert [r.call_rate for r in samples.stats_table(v).collect()] == [1.0, 0.5]


def test_order(spark):
    v = table(spark, [[(0, 0)]] * 5, chrom=["b", "a", "b", "a", "c"], pos=[5, 9, 2, 3, 1])
    s = ordering.sort_variations(v)
    assert column(s.df, "chrom") == ["a", "a", "b", "b", "c"] and column(s.df, "pos") == [3, 9, 2, 5, 1]
    assert ordering.var_bisect_left(s, "b", 2) == 2 and ordering.var_bisect_right(s, "b", 2) == 3
    assert ordering.find_le(s, "b", 4) == 2 and ordering.find_ge(s, "b", 3) == 3 and ordering.index(s, "c", 1) == 4
    with pytest.raises(IndexError):
        ordering.index(s, "c", 2)
    index = ordering.PosIndex(s)
    assert index.index_pos("a", 4) == 1 and index.index_pos("a", 99) == 2 and index.covered_length() == 9


def test_partitions_do_not_matter(spark):
    import random

    r = random.Random(1)
    v = table(spark, [[(r.choice([-1, 0, 1]), r.choice([0, 1])) for _ in range(12)] for _ in range(40)], pops={"x": [f"s{i}" for i in range(6)], "y": [f"s{i}" for i in range(6, 12)]})
    stats = lambda t: (column(variant_stats.calc_maf(t, 2), "maf"), sorted(map(tuple, populations.calc_exp_het(t, min_num_genotypes=2).collect())))
    first = stats(v)
    assert all(stats(v.having(v.df.repartition(n))) == first for n in (1, 4, 17))


def test_tajima(spark):
    v = table(spark, [[(0, 0), (0, 0), (0, 0), (0, 1), (1, 1)]] * 12)
    row = variant_stats.tajima(v, 0, haplotype=0).first()
    assert row.seg_sites == 12 and row.theta == pytest.approx(12 / (1 + 1 / 2 + 1 / 3 + 1 / 4)) and row.pi == pytest.approx(12 * 5 / 4 * (1 - 0.8**2 - 0.2**2))
    assert variant_stats.tajima(v, 0, min_num_segregating_variations=20, haplotype=0).first().d is None


def test_tails():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and chi2_tail(7.814727903251179, 3) == pytest.approx(0.05) and chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert contingency([[5, 0], [0, 5]]) == pytest.approx(0.0114, abs=1e-4) and contingency([[3], [4]]) == 1.0
    assert poisson_quantile(5, 0.99) == 11
