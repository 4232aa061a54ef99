"""Blocks of positions give what whole chromosomes gave; sources, drawing and strands; streams."""

import random

import pytest

from genomill.functions import arrays, iterables
from genomill.operators import distances, filters, histograms, merge, ordering, plots, transforms, variant_stats, windows
from genomill.sources import bam, sam, vcf
from genomill.streaming import variants
from helpers import column, table


def crowd(spark, n=400, seed=3, **more):
    r = random.Random(seed)
    chrom, pos = [r.choice("abc") for _ in range(n)], [r.randrange(1, 900) for _ in range(n)]
    gts = [[(r.choice([-1, 0, 0, 1]), r.choice([0, 1])) for _ in range(4)] for _ in range(n)]
    return table(spark, gts, chrom=chrom, pos=pos, **more), list(zip(chrom, pos, strict=True))


@pytest.mark.parametrize("block", [7, 64, 1_000_000])
def test_sorting_and_density_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ordering, "BLOCK", block)
    monkeypatch.setattr(windows, "BLOCK", block)
    v, places = crowd(spark)
    order = sorted(range(len(places)), key=lambda i: (*places[i], i))
    got = ordering.sort_variations(v.having(v.df.withColumn("id", v.df.row_idx.cast("string"))))
    assert [int(x) for x in column(got.df, "id")] == order and column(got.df, "row_idx") == list(range(len(places)))
    density = column(windows.calc_snp_density(v, 11), "density")
    assert density == [sum(c == d and abs(p - q) <= 5 for d, q in places) for c, p in places]
    few = filters.filter_variation_density(v, 3, 11)
    assert column(few.df, "row_idx") == [i for i, n in enumerate(density) if n <= 3] and few.df.columns == v.df.columns


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_overlaps_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(merge, "BLOCK", block)
    r = random.Random(5)
    rows = [("1", r.randrange(300), "A" * r.choice([1, 1, 1, 30])) for _ in range(80)]
    one = table(spark, [[(0, 0)]] * 80, chrom=[c for c, _, _ in rows], pos=[p for _, p, _ in rows], ref=[x for _, _, x in rows], alt=[["T"]] * 80)
    got = [tuple(x)[1:] for x in merge.group_counts(one.df, one.df).orderBy("group").collect()]
    reach, sizes = -1, []
    for _, p, x in sorted(rows, key=lambda y: y[1]):
        if p > reach:
            sizes.append(0)
        sizes[-1] += 1
        reach = max(reach, p + len(x) - 1)
    assert got == [(i + 1, n, n) for i, n in enumerate(sizes)]


def test_strands(spark):
    v = table(spark, [[(0, 0)]] * 3, ref=["A", "C", "C"], alt=[["C"], None, ["A"]])
    like = [[True, False, True], [True, True, False], [True, True, False]]
    strands = spark.createDataFrame([(i, ["G", "T"], x) for i, x in enumerate(like)], "row_idx long, alleles array<string>, like_reference array<boolean>")
    got = [tuple(x) for x in transforms.count_compatible_snps(v, strands).orderBy("strand").collect()]
    assert got == [(0, 0, 3), (1, 1, 3), (2, 2, 3)]
    assert transforms.count_compatible_snps(v, strands, max_snps_check=1).orderBy("strand").first().checked == 1


def test_drawing_is_exact_and_repeatable(spark):
    v, _ = crowd(spark, 90)
    called = sum(column(variant_stats.calc_called_gt(v, rates=False), "called"))
    left = transforms.set_random_missing(v, 0.9)
    after = sum(column(variant_stats.calc_called_gt(left, rates=False), "called"))
    assert called - after == round(called * 0.9) and left.df.columns == v.df.columns
    again = transforms.set_random_missing(v.having(v.df.repartition(5)), 0.9)
    assert sorted(map(str, left.df.collect())) == sorted(map(str, again.df.collect()))
    kept = lambda t: column(filters.VarsSamplingFilter(0.5, 7)(t).kept.df, "row_idx")
    assert kept(v) == kept(v.having(v.df.repartition(6))) and len(kept(v)) == 45
    assert ordering.sample_variations(v, 0.5, chunk_size=30).num_variations() == 45


def test_selected_distances_are_renumbered(spark):
    dists = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)], "i int, j int, dist double")
    got = {(r.i, r.j): r.dist for r in distances.select_samples(dists, [2, 0]).collect()}
    assert got == {(0, 1): 2.0}


def test_quantiles_in_order(spark, monkeypatch):
    monkeypatch.setattr(plots, "CUTS", 9)
    r = random.Random(2)
    values = [r.choice([r.random(), 0.5]) for _ in range(120)]
    rows = spark.createDataFrame([(x,) for x in [*values, None]], "x double").repartition(4)
    got = sorted((x.x, x.share) for x in plots.qq(rows, lambda s: s).collect())
    assert got == [(x, pytest.approx((i + 0.5) / 120)) for i, x in enumerate(sorted(values))]
    assert plots.qq(rows.limit(0), lambda s: s).count() == 0
    hist = histograms.histogram_of(rows, 4, (0, 1))
    assert {x.series for x in plots.boxplots_of_series({"a": hist, "b": hist}).collect()} == {"a", "b"}


READS = [
    "@SQ\tSN:x\tLN:90", "@SQ\tSN:y\tLN:50", "@RG\tID:g1\tSM:one", "@RG\tID:g2\tSM:two",
    "a\t0\tx\t5\t30\t8M2I4M1D3M\t*\t0\t0\tTTAGATAAAGGATACTG\t*\tNM:i:3\tRG:Z:g1", "b\t0\tx\t9\t30\t2S6M\t*\t0\t0\tNNACGTAC\t*\tRG:Z:g2",
    "c\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*", "d\t16\ty\t3\t9\t5M\t*\t0\t0\tACGTN\t*", "e\t0\ty\t3\t9\t7M\t*\t0\t0\tACGTACG\t*\tRG:Z:none",
]


def test_binary_alignments_are_read_as_text_is(spark, tmp_path):
    (tmp_path / "a.sam").write_text("".join(f"{x}\n" for x in READS))
    (tmp_path / "a.bam").write_bytes(bam.encode(READS))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(sam.read_kmers(spark, [str(tmp_path / "a.sam")], 3))
    assert rows(bam.read_kmers(spark, [str(tmp_path / "a.bam")], 3)) == want and len(want) > 10
    region = [("x", 8, 11)]
    assert rows(bam.read_kmers(spark, [str(tmp_path / "a.bam")], 3, regions=region)) == rows(sam.read_kmers(spark, [str(tmp_path / "a.sam")], 3, regions=region))
    tags = b"XBBs\x02\0\0\0\1\0\2\0XCc\x05XZZtext\0RGZg9\0"
    assert bam.read_group(tags) == "g9" and bam.read_group(b"") is None
    (tmp_path / "bad.bam").write_bytes(b"\x1f\x8b")
    with pytest.raises(Exception):  # noqa: B017
        bam.read_kmers(spark, [str(tmp_path / "bad.bam")], 3).collect()


def test_lines_and_chromosomes_of_a_text(spark, tmp_path):
    head = "".join(f"##x{i}=1\n" for i in range(700)) + "##FORMAT=<ID=GT,Number=1,Type=String,Description=\"g\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    body = "b\t1\t.\tA\tC\t.\t.\t.\tGT\t0/1\na\t2\t.\tA\tC\t.\t.\t.\tGT\t1/1\n"
    (tmp_path / "a.vcf").write_text(head + body)
    path = str(tmp_path / "a.vcf")
    assert vcf.read_vcf(spark, path).samples == ["s"] and vcf.chroms_of(spark, path) == ["a", "b"]
    assert [r.value.split("\t")[1] for r in vcf.lines_of(spark, path, "a").collect()] == ["2"]
    (tmp_path / "b.vcf").write_text(head)
    empty = vcf.read_vcf(spark, str(tmp_path / "b.vcf"))
    assert empty.num_variations() == 0 and empty.samples == ["s"]


def test_streams_filter_what_arrives(spark, tmp_path):
    v = table(spark, [[(0, 0), (0, 1)], [(0, 0), (0, 0)], [(-1, -1), (0, 1)]], chrom=["a", "a", "b"])
    path = str(tmp_path / "store")
    v.write(path)
    stream = variants.read_store(spark, path, v)
    query = variants.filtered(stream, [filters.MinCalledGTsFilter(0.9)]).writeStream.format("memory").queryName("kept").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(60)
    assert sorted(r.row_idx for r in spark.table("kept").collect()) == [0, 1]
    query = variants.counts_by_chrom(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination(60)
    assert {r.chrom: r.n for r in spark.table("counts").collect()} == {"a": 2, "b": 1}


def test_iterators_and_arrays(spark):
    assert list(iterables.packets("abcde", 2)) == [("a", "b"), ("c", "d"), ("e",)]
    assert list(iterables.groups("abc", 2, "x")) == [("a", "b"), ("c", "x")] and list(iterables.groups("", 2)) == []
    look = iterables.Peekable(range(4))
    assert [look.peek(), look.peek(), next(look), look.peek()] == [0, 1, 0, 2]
    look.reset_peek()
    assert [look.peek(), *look] == [1, 1, 2, 3]
    with pytest.raises(StopIteration):
        look.peek()
    queue = iterables.CompressedQueue()
    queue.put_all(({"n": i, "x": "y" * 100} for i in range(2000)), most=1500)
    assert len(queue) == 1500 and [x["n"] for x in queue] == list(range(1500)) == [x["n"] for x in queue] and len(queue.blocks) > 1
    rows = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, None)], "row_idx long, x array<int>")
    assert column(arrays.stacked([rows, spark.createDataFrame([(3, [1, 2, 3, 4])], rows.schema)], "x", -1), "x") == [[1, 2, 3, -1], [-1] * 4, None, [1, 2, 3, 4]]
    assert column(rows.select("row_idx", arrays.resized(rows.x, 2, 0).alias("x")), "x") == [[1, 2], [0, 0], None]
