import numpy as np
import pytest

from genomill.operators import blocks, distances, filters, linkage, merge, multivariate, plots, trees
from genomill.operators.pipeline import Pipeline
from genomill.operators.table import Variations
from genomill.sinks import fasta, tables, vcf as vcf_sink
from genomill.sources import matrix_text, sam, vcf
from helpers import column, table


def pairs(df, a="i", b="j"):
    return {(r[a], r[b]): r["dist"] for r in df.collect()}


# Genotypes whose distances are known, and these distances.
KOSMAN_GTS = {
    "a": [(-1, -1), (0, 0), (0, 1), (0, 0), (0, 0), (0, 1), (0, 1), (0, 1), (0, 0), (0, 0), (0, 1)],
    "b": [(1, 1), (-1, -1), (0, 0), (0, 0), (1, 1), (0, 1), (1, 0), (1, 0), (1, 0), (0, 1), (1, 2)],
    "c": [(1, 1)] * 11,
}
KOSMAN = {(0, 1): 1 / 3, (0, 2): 0.75, (0, 3): 0.75, (1, 2): 0.5, (1, 3): 0.5, (2, 3): 0}
NEI_GTS = [[(0, 0)] * 3 + [(1, 1)] * 3 + [(1, 0)], [(0, 0)] * 3 + [(1, 1)] * 4, [(0, 0)] * 3 + [(1, 1)] * 4]
NEI, NEI_WITH_ONE_MORE = 3.14019792, 1.23732507
UNBIASED_GTS = [[(1, 1), (5, 2), (2, 2), (3, 2)], [(1, 1), (1, 2), (2, 2), (2, 1)], [(-1, -1)] * 4]
UNBIASED = 0.3726315908494797
DEST_GTS = [
    [(1, 1), (1, 3), (1, 2), (1, 4), (3, 3), (3, 2), (3, 4), (2, 2), (2, 4), (4, 4), (-1, -1)],
    [(1, 3), (1, 1), (1, 1), (1, 3), (3, 3), (3, 2), (3, 4), (2, 2), (2, 4), (4, 4), (-1, -1)],
]
DEST = 0.65490196


def test_kosman_and_matching(spark):
    a, b, c = (KOSMAN_GTS[k] for k in "abc")
    v = table(spark, list(zip(a, b, c, c, strict=True)))
    assert pairs(distances.calc_pairwise_distance(v)) == pytest.approx(KOSMAN)
    assert pairs(distances.calc_pairwise_distance(v, min_num_snps=11))[2, 3] == 0 and pairs(distances.calc_pairwise_distance(v, min_num_snps=11))[0, 1] is None
    assert pairs(distances.calc_pairwise_distances_between_pops(v, ["s0"], ["s1", "s2"])) == {(0, 1): pytest.approx(1 / 3), (0, 2): 0.75}
    assert pairs(distances.calc_matching(v))[2, 3] == 1


def test_population_distances(spark):
    names = list("1234567")
    v = table(spark, NEI_GTS, samples=names)
    nei = lambda pops: distances.calc_pop_distance(v, pops, "nei", 0).first().dist
    assert nei({"a": names[:3], "b": names[3:]}) == pytest.approx(NEI)
    assert nei({"a": names[:3], "b": [names[0], *names[3:]]}) == pytest.approx(NEI_WITH_ONE_MORE)
    u = table(spark, UNBIASED_GTS, samples=list("1234"))
    assert distances.calc_pop_distance(u, {"a": ["1", "2"], "b": ["3", "4"]}, "nei_unbiased", 1).first().dist == pytest.approx(UNBIASED)
    w = table(spark, DEST_GTS)
    pops = {"a": [f"s{i}" for i in range(5)], "b": [f"s{i}" for i in range(5, 11)]}
    assert distances.calc_pop_distance(w, pops, "dest", 0).first().dist == pytest.approx(DEST)


def test_linkage(spark):
    v = table(spark, [[(0, 0), (0, 1), (1, 1), (0, 0)], [(0, 0), (0, 1), (1, 1), (0, 0)], [(1, 1), (0, 1), (0, 0), (0, 1)], [(0, 0), (0, 1), (1, 1), (0, 0)]], chrom=["1", "1", "1", "2"], pos=[1, 5, 300, 1])
    got = {(r.a, r.b): r.r for r in linkage.calc_ld_along_genome(v, 100, min_num_gts=2).collect()}
    assert got == {(0, 1): pytest.approx(1)}
    assert {(r.a, r.b) for r in linkage.iterate_pairs(v, 299).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert linkage.pairwise_ld(v).count() == 6
    with pytest.raises(ValueError):
        linkage.calc_ld_along_genome(table(spark, [[(0, 0)] * 4]), 10)
    assert linkage.calc_ld_random_pairs_from_different_chroms(v, 5, min_num_gts=2).count() <= 5


def test_blocks(spark):
    hom = lambda *a: [(x, x) for x in a]
    gts = [hom(0, 0, 0, 0)] * 2 + [hom(1, 1, 1, 1), hom(2, 2, 2, 2)] + [hom(2, 2, 0, 0)] * 2 + [hom(0, 0, 2, 2)] + [hom(0, 0, 0, 0)] * 4
    v = table(spark, gts, chrom=["1"] * 9 + ["2"] * 2, pos=[11, 12, 13, 14, 16, 17, 18, 20, 21, 10, 11])
    got = [tuple(r) for r in blocks.generate_blocks(v, min_num_gts_compared=4).orderBy("start_idx").collect()]
    assert got == [("1", 11, 15, 0, 4), ("1", 16, 19, 4, 7), ("1", 20, 22, 7, 9), ("2", 10, 12, 9, 11)]
    # agreeing, unknown, agreeing, other: the unknown one stays inside
    dose = np.array([[0, 2, 0, 2], [-1] * 4, [0, 2, 0, 2], [0, 0, 2, 2]])
    assert list(blocks.scan(dose, min_num_gts_compared=4)) == [(0, 3), (3, 4)]


def test_block_records(spark):
    v = table(spark, [[(0, 0), (1, 1), (0, 0)], [(0, 0), (1, 1), (1, 1)]], ref=["A", "G"], alt=[["T"], ["GC"]])
    b = spark.createDataFrame([("1", 0, 2)], "chrom string, start_idx long, stop_idx long")
    r = blocks.group_variations(v, b).first()
    assert (r.ref, r.alt, r.sn, r.aa, r.gts) == ("AG", ["TGC", "AGC"], 2, ["AG-", "TGC", "AGC"], [[0, 0], [1, 1], [2, 2]])


def test_merge(spark):
    one = table(spark, [[(0, 0), (1, 1)], [(0, 1), (1, 1)]], pos=[1, 10], ref=["C", "A"], alt=[["CAAG", "CAAA"], ["T"]], samples=["a", "b"], qual=[34, 5])
    two = table(spark, [[(0, 0), (1, 1)], [(0, 0), (1, 1)]], pos=[1, 30], ref=["C", "G"], alt=[["T"], None], samples=["c", "d"], qual=[20, 7])
    got = merge.merge(one, two)
    rows = got.df.orderBy("row_idx").collect()
    assert [r.pos for r in rows] == [1, 10, 30] and got.samples == list("abcd")
    assert rows[0].alt == ["CAAG", "CAAA", "T"] and rows[0].qual == 20 and [c.gt for c in rows[0].calls] == [[0, 0], [1, 1], [0, 0], [3, 3]]
    assert [c.gt for c in rows[1].calls] == [[0, 1], [1, 1], [None, None], [None, None]]
    assert merge.merge(one, two, ignore_non_matching=True).num_variations() == 1
    crowd = table(spark, [[(0, 0)], [(0, 0)]], pos=[1, 2], samples=["e"], ref=["A", "A"], alt=[["T"], ["T"]])
    with pytest.raises(Exception, match="can't be merged"):
        merge.merge(one, crowd).df.collect()
    assert merge.merge(one, crowd, ignore_complex_overlaps=True).num_variations() == 1
    assert [tuple(r)[2:] for r in merge.group_counts(one.df, two.df).orderBy("group").collect()] == [(1, 1), (1, 0), (0, 1)]


def test_pipeline_and_store(spark, tmp_path):
    v = table(spark, [[(0, 0), (0, 1)], [(0, 0), (0, 0)], [(-1, -1), (0, 1)]], pops={"x": ["s0"]})
    out, results = Pipeline().append(filters.MinCalledGTsFilter(0.9), "called").append(filters.NonBiallelicFilter(), "two").run(v)
    assert column(out.df, "row_idx") == [0]
    assert [tuple(r)[2:] for r in Pipeline.stats(results).orderBy("order").collect()] == [(2, 1, 3), (1, 1, 2)]
    v.write(str(tmp_path / "store"))
    back = Variations.read(spark, str(tmp_path / "store"))
    assert back.samples == v.samples and back.populations == {"x": ["s0"]} and back.num_variations() == 3
    assert back.put(v.df.drop("qual")).num_variations() == 6
    assert [c for c, _ in v.by_chrom(["1", "none"])] == ["1"]


VCF = """##fileformat=VCFv4.2
##source=here
##INFO=<ID=NS,Number=1,Type=Integer,Description="Samples, with data">
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##FILTER=<ID=q10,Description="low">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=HQ,Number=2,Type=Integer,Description="Quality">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty
20\t143\trs6\tG\tA\t29\tPASS\tNS=3;AF=0.5;DB\tGT:DP:HQ\t0|0:1:51,51\t1/0:8:.,.
20\t173\t.\tT\tA,C\t3.5\tq10\tNS=3;AF=0.017,0.2\tGT:DP\t./.:3\t2/1
21\t200\t.\tT\t.\t.\t.\t.\tGT\t0/0\t.
"""


def test_vcf(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(VCF)
    v = vcf.read_vcf(spark, str(path))
    rows = v.df.orderBy("row_idx").collect()
    assert v.samples == ["x", "y"] and v.ploidy == 2 and [r.row_idx for r in rows] == [0, 1, 2]
    assert [[c.gt for c in r.calls] for r in rows] == [[[0, 0], [1, 0]], [[None, None], [2, 1]], [[0, 0], [None, None]]]
    assert rows[0].calls[0].hq == [51, 51] and rows[0].calls[1].hq == [None, None] and rows[1].calls[1].dp is None
    assert rows[0].info.DB and not rows[1].info.DB and rows[1].info.AF == [0.017, 0.2] and rows[2].info.NS is None
    assert [r.filters for r in rows] == [{"q10": 1}, {"q10": 0}, {"q10": None}]
    assert rows[2].alt is None and rows[2].qual is None and v.metadata["INFO"]["NS"]["Description"] == "Samples, with data"
    vcf_sink.write_vcf(v, str(tmp_path / "out"), single=True)
    again = vcf.read_vcf(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in again.df.orderBy("row_idx").collect()] == [tuple(r) for r in rows]
    with pytest.raises(ValueError):
        vcf.read_vcf(spark, str(path), kept_fields=["calls/XX"])
    assert "info" in vcf.read_vcf(spark, str(path), ignored_fields=["calls/HQ"]).df.columns


def test_matrix_text(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("ID\ta\tb\tc\td\ns1\tAA\tAC\tGG\t\ns2\tCC\t--\tTC\tCC\n")
    info = spark.createDataFrame([("s1", "1", 5), ("s2", "1", 9)], "id string, chrom string, pos int")
    v = matrix_text.read_matrix(spark, str(path), info, sep="\t")
    rows = v.df.orderBy("pos").collect()
    assert [(r.ref, r.alt) for r in rows] == [("A", ["C", "G"]), ("C", ["T"])]
    assert [c.gt for c in rows[0].calls] == [[0, 0], [0, 1], [2, 2], [None, None]] and [c.gt for c in rows[1].calls][2] == [1, 0]


SAM = "@SQ\tSN:ref\tLN:45\n@RG\tID:l1\tSM:one\n@RG\tID:l2\tSM:two\nr1\t99\tref\t7\t30\t8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTG\t*\tRG:Z:l1\nr4\t0\tref\t16\t30\t6M14N5M\t*\t0\t0\tATAGCTTCAGC\t*\tRG:Z:l2\n"


def test_sam(spark, tmp_path):
    path = tmp_path / "a.sam"
    path.write_text(SAM)
    kmers = sam.read_kmers(spark, [str(path)], 4)
    first = kmers.orderBy("pos").first()
    assert (first.ref, first.pos, first.sample, first.kmer, first.n) == ("ref", 6, "one", "TTAG", 1)
    assert {r.pos for r in sam.covered(kmers, min_num_samples=2).collect()} == {15, 16, 17}
    assert sam.infer_alleles({"AAAA": 10, "CCCC": 9, "AAAT": 1}) == {"AAAA": 11, "CCCC": 9}
    assert sam.infer_alleles({"AAAA": 30, "CCCC": 3}) == {"AAAA": 30}
    assert sam.genotypes(kmers).count() == kmers.select("pos", "sample").distinct().count()


def test_fasta_and_workbook(spark, tmp_path):
    v = table(spark, [[(0, 0), (0, 1)], [(1, 1), (-1, 1)]], ref=["A", "C"], alt=[["T"], ["G"]])
    got = {r.name: r.sequence for r in fasta.sequences(v).collect()}
    assert got == {"s0_hap1": "AG", "s0_hap2": "AG", "s1_hap1": "AN", "s1_hap2": "TG"}
    assert {r.name: r.sequence for r in fasta.sequences(v, one_per_sample=True).collect()} == {"s0": "AG", "s1": "NN"}
    assert fasta.fix_lengths(["A", "AT"], True, True) == ["A-", "AT"] and fasta.fix_lengths(["ATT", "A"], True, True) == ["ATT", "A--"]
    tables.write_excel(v, str(tmp_path / "a.xlsx"), {"s0": "k"})
    assert (tmp_path / "a.xlsx").stat().st_size > 500
    assert tables.write_curlywhirly(["a"], [[1, 2]], ["x", "y"]).splitlines()[1] == "a\t1\t2"


def test_trees():
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]], dtype=float)
    t = trees.do_tree(d, list("abcd"), "upgma")
    assert t.newick() == "((a:1,b:1):2,(c:2,d:2):1);" and len(trees.get_subtrees(t, 0.5)) == 2 and trees.get_subtrees(t, 0) == [t]
    nj = trees.do_tree(d, list("abcd"), "nj")
    assert sorted(x.name for x in nj.leaves()) == list("abcd")
    with pytest.raises(ValueError):
        trees.do_tree(d, list("abcd"), "other")
    text = trees.write_nexus(trees.annotate_tree(t, {"a": {"k": 1}}), trees.FigtreeConfig(branch_line_width=2))
    assert "ntax=4" in text and "'a'[&k=1]" in text and "appearance.branchLineWidth" in text


def test_ordination(spark):
    d = np.array([[0, 3, 4], [3, 0, 5], [4, 5, 0]], dtype=float)
    got = multivariate.do_pcoa(d)
    x = got["projections"]
    assert np.allclose(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), d) and got["var_percentages"].sum() == pytest.approx(100)
    with pytest.raises(ValueError):
        multivariate.do_pcoa(np.array([[0, np.nan], [np.nan, 0]]))
    assert multivariate.non_param_multi_dim_scaling(d, 2)["stress"] < 1e-2
    v = table(spark, [[(0, 0), (0, 1), (1, 1)], [(0, 0), (0, 0), (1, 1)], [(1, 1), (0, 1), (0, 0)], [(0, 1), (0, 0), (0, 0)]])
    m = np.array([r.dose for r in __import__("genomill.operators.transforms", fromlist=["x"]).gts_as_mat012(v).orderBy("row_idx").collect()], dtype=float)
    s = np.linalg.svd((m - m.mean(axis=1, keepdims=True)).T, compute_uv=False)
    assert np.allclose(multivariate.do_pca(v)["var_percentages"][:3], s**2 / (s**2).sum() * 100)
    assert multivariate.isomap(v, 2).shape == (3, 2) and multivariate.do_pcax(v, 2)["projections"].shape == (3, 2)


def test_plot_numbers(spark):
    rows = spark.createDataFrame([("1", 5, 0.1), ("1", 9, 0.2), ("2", 3, 0.3)], "chrom string, pos int, value double")
    assert [r.x for r in plots.manhattan(rows).orderBy("x").collect()] == [5, 9, 12]
