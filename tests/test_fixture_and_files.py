"""The derived fixture by many tasks, and text that is read from several files."""

import math

import pyarrow as pa
from pyspark.sql import functions as F

from genomill.operators import filters
from genomill.plans import fixture, registry, tables
from genomill.sinks import fasta, vcf as vcf_sink
from genomill.sources import vcf
from helpers import table


def test_calls_are_worked_out_once_and_by_many_tasks(spark):
    """The statistic of a filter refers to the calls several times, and the variants lie in one group of rows."""
    v = registry.load(spark, "/root/testdata/sf0.01")
    assert v.df.select("calls").rdd.getNumPartitions() == 4
    plan = filters.ObsHetFilter(0.1, 0.5)(v).kept.df.select("row_idx")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "15485863" not in plan
    assert v.df.select("chrom")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0


def test_calls_are_those_of_the_sql(spark):
    rem = lambda a, b: int(math.fmod(a, b))
    vids, sids = [0, 1, 5, 49, 777, 19_999, 1_200_000, 7_199_999], [0, 3, 24]
    got = fixture.calls_of(sids)(pa.array(vids, pa.int64())).to_pylist()
    for vid, calls in zip(vids, got, strict=True):
        for sid, call in zip(sids, calls, strict=True):
            gt = []
            for k in (0, 1):
                h = rem(vid * 7919 + sid * 104729 + k * 15485863 + vid * sid * 31, 1000)
                gt.append(None if rem(vid * 6101 + sid * 7907 + vid * sid * 17, 100) < 8 else 1 if h < rem(vid * 37, 50) * 20 else 2 if h >= 985 else 0)
            dp, gq = rem(vid * 13 + sid * 29 + vid * sid * 7, 40), rem(vid * 11 + sid * 41 + vid * sid * 3, 60)
            other = dp * sum((a or 0) > 0 for a in gt) // 2
            assert call == {"gt": gt, "dp": dp, "gq": gq, "ro": dp - other, "ao": [other], "ad": [dp - other, other]}
    assert fixture.calls_of(sids)(pa.array([], pa.int64())).to_pylist() == []
    assert fixture.calls_of([])(pa.array([1, 2], pa.int64())).to_pylist() == [[], []]


def test_lines_of_many_files_keep_their_order(spark, tmp_path):
    """Spark reads large files first, and blocks of a file by their size: neither the header nor row_idx may follow that."""
    v = tables.described(registry.load(spark, "/root/testdata/sf0.001"))
    path = tmp_path / "parts"
    path.mkdir()
    vcf_sink.write_vcf(v, str(tmp_path / "one"), single=True)
    lines = next((tmp_path / "one").glob("*.txt")).read_text().splitlines()
    cuts = [0, 3, 40, 45, 120, len(lines)]
    assert lines[3].startswith("#")  # the header lies in two files
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (path / f"part {i}%.txt").write_text("".join(x + "\n" for x in lines[a:b]))
    wanted = [x.split("\t")[2] for x in lines if not x.startswith("#")]
    for size in ("128m", "7k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = vcf.read_vcf(spark, str(path))
            rows = got.df.select("row_idx", "id", F.size("calls").alias("n")).orderBy("row_idx").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got.samples == v.samples
        assert [r.id for r in rows] == wanted and [r.row_idx for r in rows] == list(range(len(wanted))) and {r.n for r in rows} == {25}


def test_header_stays_whole_before_the_first_line(spark, tmp_path):
    """With as many parts as there are, the header lies in the first."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        v = registry.load(spark, "/root/testdata/sf0.001")
        vcf_sink.write_vcf(v, str(tmp_path / "out"))
        got = vcf.read_vcf(spark, str(tmp_path / "out"))
        rows = got.df.select("row_idx", "chrom", "pos").orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.enabled")
    texts = [f.read_text() for f in sorted((tmp_path / "out").glob("*.txt"))]
    assert len(texts) > 10 and texts[0].startswith("##fileformat") and "#CHROM" in texts[0] and not any("#" in t for t in texts[1:])
    assert [(r.chrom, r.pos) for r in rows] == sorted((r.chrom, r.pos) for r in rows) and len(rows) == 200


def test_sequences_are_joined_by_blocks(spark, monkeypatch):
    """What is collected for a sequence is pieces, not a row for each call; blocks meet in order and may have gaps."""
    monkeypatch.setattr(fasta, "BLOCK", 7)
    gts = [[(i * (j + 2) * (h + 3) // 2 % 5 % 3 if (i + j) % 6 else -1 for h in (0, 1)) for j in range(3)] for i in range(60)]
    v = table(spark, [[tuple(c) for c in row] for row in gts], alt=[["C", "G"]] * 60)
    v = v.having(v.df.where("row_idx not between 14 and 34").repartition(5))
    rows = fasta.sequences(v)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan and "hap_alleles" not in plan
    got = {(r.sample_idx, r.hap, r.name): r.sequence for r in rows.collect()}
    kept = [r for r in v.df.orderBy("row_idx").collect() if any(a is not None for c in r["calls"] for a in c.gt)]
    kept = [r for r in kept if sum(a is None for c in r["calls"] for a in c.gt) < 3]
    wanted = {(j, h, f"s{j}_hap{h + 1}"): "".join("N" if r["calls"][j].gt[h] is None else "ACG"[r["calls"][j].gt[h]] for r in kept) for j in range(3) for h in (0, 1)}
    assert got == wanted and len(kept) > 20
    assert fasta.sequences(v.only_samples([])).count() == 0
