"""Queries on sources, sinks and the table itself: what is written is read again and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __main__ as cli
from ..functions import arrays
from ..operators import distances, trees
from ..operators.table import Variations
from ..sinks import fasta, tables as table_sinks, vcf as vcf_sink
from ..sources import bam, matrix_text, sam, vcf
from . import fixture
from .registry import CALLED, ORACLES, QUERIES, query
from .scratch import place

CALL = "cast(sid as int) as sample_idx"

# --- VCF

FORMAT = {
    "GT": {"Number": 1, "Type": "String", "Description": "genotype"}, "DP": {"Number": 1, "Type": "Integer", "Description": "depth"},
    "GQ": {"Number": 1, "Type": "Integer", "Description": "quality"}, "RO": {"Number": 1, "Type": "Integer", "Description": "reference reads"},
    "AO": {"Number": "A", "Type": "Integer", "Description": "other reads"}, "AD": {"Number": "R", "Type": "Integer", "Description": "reads of alleles"},
}
INFO = {
    "NS": {"Number": 1, "Type": "Integer", "Description": "a number"}, "AF": {"Number": "A", "Type": "Float", "Description": "two shares"},
    "AA": {"Number": 1, "Type": "String", "Description": "a letter, or unknown"}, "H2": {"Number": 0, "Type": "Flag", "Description": "a flag"},
}
FILTER = {"q10": {"Description": "quality, so-so"}, "s50": {"Description": "samples"}}


def described(v: Variations) -> Variations:
    """The fixture with INFO and FILTER."""
    info = F.struct(
        (F.col("row_idx") % 7).cast("int").alias("NS"), F.array((F.col("row_idx") % 4) / 4, F.lit(0.5)).alias("AF"),
        F.when(F.col("row_idx") % 5 != 0, F.col("ref")).alias("AA"), (F.col("row_idx") % 2 == 0).alias("H2"),
    )
    failed = lambda k: F.when(F.col("row_idx") % 6 == 0, F.lit(None).cast("int")).otherwise((F.col("row_idx") % 6 > k).cast("int"))
    applied = F.create_map(F.lit("q10"), failed(1), F.lit("s50"), failed(3))
    df = v.df.withColumn("info", info).withColumn("filters", applied)
    return v.having(df, metadata={"INFO": INFO, "FORMAT": FORMAT, "FILTER": FILTER, "OTHER": {"source": "fixture"}, "fileformat": "VCFv4.2"})


def vcf_text(v: Variations, name: str = "vcf") -> str:
    path = place(v.df.sparkSession, name)
    vcf_sink.write_vcf(described(v), path)
    return path


def read_back(v: Variations, **options) -> Variations:
    return vcf.read_vcf(v.df.sparkSession, vcf_text(v), **options)


ORDERED = ", o as (select *, row_number() over (order by chrom, pos) - 1 as place from v)"
query("vcf_variants", ORDERED + (
    " select place as row_idx, chrom, cast(pos as int) as pos, cast(vid as varchar) as id, ref, alt1 || ',' || alt2 as alt"
    ", round(qual, 4) as qual from o"
))(
    lambda v: read_back(v).df.select("row_idx", "chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), "qual")
)
query(
    "vcf_calls",
    ORDERED + f" select place as row_idx, {CALL}, a0, a1, cast(dp as int) as dp, cast(gq as int) as gq,"
    " cast(dp - dp * (cast(coalesce(a0, 0) > 0 as int) + cast(coalesce(a1, 0) > 0 as int)) // 2 as int) as ro from g join o using (vid)",
)(lambda v: read_back(v).long().select("row_idx", "sample_idx", F.col("gt")[0].alias("a0"), F.col("gt")[1].alias("a1"), "dp", "gq", "ro"))
query("vcf_observations", ORDERED + f", x as (select vid, sid, dp, cast(dp * (cast(coalesce(a0, 0) > 0 as int) + cast(coalesce(a1, 0) > 0 as int)) // 2 as bigint) as o from g) select place as row_idx, {CALL}, cast(x.o as int) as ao, cast(dp - x.o as int) as ad0, cast(x.o as int) as ad1 from x join o using (vid)")(
    lambda v: read_back(v, kept_fields=["calls/AO", "calls/AD"]).long().select("row_idx", "sample_idx", F.col("ao")[0].alias("ao"), F.col("ad")[0].alias("ad0"), F.col("ad")[1].alias("ad1"))
)
query("vcf_info", ORDERED + (
    " select place as row_idx, cast(vid % 7 as int) as ns, cast(vid % 4 as double) / 4 as af, case when vid % 5 <> 0 then ref end as aa"
    ", vid % 2 = 0 as h2 from o"
))(
    lambda v: read_back(v).df.select("row_idx", F.col("info.NS").alias("ns"), F.col("info.AF")[0].alias("af"), F.col("info.AA").alias("aa"), F.col("info.H2").alias("h2"))
)
query("vcf_filters", ORDERED + (
    " select place as row_idx, case when vid % 6 <> 0 then cast(vid % 6 > 1 as int) end as q10"
    ", case when vid % 6 <> 0 then cast(vid % 6 > 3 as int) end as s50 from o"
))(
    lambda v: read_back(v).df.select("row_idx", F.col("filters")["q10"].alias("q10"), F.col("filters")["s50"].alias("s50"))
)
query("vcf_header", " select cast(sid as int) as place, sample, 2 as ploidy, 'GT DP GQ RO AO AD' as format, 'NS AF AA H2' as info from s")(
    lambda v: (lambda r: v.df.sparkSession.createDataFrame([(i, s, r.ploidy, " ".join(r.metadata["FORMAT"]), " ".join(r.metadata["INFO"])) for i, s in enumerate(r.samples)], "place int, sample string, ploidy int, format string, info string"))(read_back(v))
)
query("vcf_lines", " select chrom, vid % 2 = 0 as flag, count(*) as n from v where chrom = 'chr2' group by 1, 2")(
    lambda v: vcf.lines_of(v.df.sparkSession, vcf_text(v), "chr2").select(F.split("value", "\t").alias("f")).groupBy(F.col("f")[0].alias("chrom"), F.col("f")[7].contains("H2").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
)
query("vcf_chroms", " select distinct chrom from v")(
    lambda v: v.df.sparkSession.createDataFrame([(c,) for c in vcf.chroms_of(v.df.sparkSession, vcf_text(v))], "chrom string")
)


def _zipped(v: Variations) -> DataFrame:
    """The text as a gzipped file, as it comes from elsewhere."""
    spark, path, one = v.df.sparkSession, place(v.df.sparkSession, "vcf-gz"), place(v.df.sparkSession, "vcf-one")
    vcf_sink.write_vcf(described(v.chunk(0, 500)), one, single=True)
    spark.read.text(one).coalesce(1).write.option("compression", "gzip").text(path)
    return vcf.read_vcf(spark, path).df.select("chrom", "pos", F.size("calls").alias("samples"))


query("vcf_gzip", " select chrom, cast(pos as int) as pos, 25 as samples from v where vid < 500")(_zipped)
query("vcf_text_lines", ORDERED + (
    ", tx as (select vid"
    ", string_agg(coalesce(cast(a0 as varchar), '.') || '/' || coalesce(cast(a1 as varchar), '.') || ':' || dp || ':' || gq"
    ", chr(9) order by sid) as calls from g group by 1) select place, concat_ws(chr(9), chrom, pos, vid, ref, alt1 || ',' || alt2"
    ", calls) as line from o join tx using (vid)"
))(
    lambda v: _text(v)
)


def _text(v: Variations) -> DataFrame:
    plain = v.having(v.df.withColumn("calls", F.transform("calls", lambda c: F.struct(c["gt"].alias("gt"), c["dp"].alias("dp"), c["gq"].alias("gq")))))
    f = F.split("value", "\t")
    rows = vcf_sink.body(plain).select("chrom", "pos", F.concat_ws("\t", F.slice(f, 1, 5), F.slice(f, 10, len(v.samples))).alias("line"))
    return rows.select(*_place(), "line")


def _place():
    from pyspark.sql import Window

    return [(F.row_number().over(Window.orderBy("chrom", "pos")) - 1).cast("long").alias("place")]


def _stored(v: Variations) -> Variations:
    path = place(v.df.sparkSession, "store")
    vcf.vcf_to_store(v.df.sparkSession, vcf_text(v), path)
    return Variations.read(v.df.sparkSession, path)


query("vcf_to_store", CALLED + ORDERED + " select place as row_idx, cast(m as bigint) as called from o join cd using (vid)")(
    lambda v: (lambda s: _n_called(s))(_stored(v))
)


def _n_called(v: Variations) -> DataFrame:
    from ..operators.variant_stats import calc_called_gt

    return calc_called_gt(v, rates=False)


# --- genotype matrices

BASES = "list_extract([ref, alt1, alt2], a + 1)"


def matrix(v: Variations, name: str, cell) -> tuple[str, DataFrame]:
    """A text of id and a column for each sample, and where the variants are."""
    spark, path = v.df.sparkSession, place(v.df.sparkSession, name)
    every = F.concat(F.array("ref"), "alt")
    cells = F.transform("calls", lambda c: cell(F.transform(c["gt"], lambda a: F.get(every, a))))
    head = spark.createDataFrame([(-1, ",".join(["id", *v.samples]))], "row_idx long, value string")
    lines = head.unionByName(v.df.select("row_idx", F.concat_ws(",", "id", F.array_join(cells, ",")).alias("value")))
    lines.coalesce(1).sortWithinPartitions("row_idx").select("value").write.text(path)
    return path, v.df.select("id", "chrom", "pos")


def _pair(letters):
    return F.when(F.exists(letters, lambda a: a.isNull()), "--").otherwise(F.array_join(letters, ""))


def _code(letters):
    codes = F.create_map(*[F.lit(x) for k, two in matrix_text.IUPAC.items() for x in ("".join(sorted(two)), k)])
    return F.when(F.exists(letters, lambda a: a.isNull()), "-").otherwise(F.try_element_at(codes, F.array_join(F.array_sort(letters), "")))


NUMBERED = (
    ", l as (select vid, sid, list_extract([ref, alt1, alt2], a0 + 1) as x, list_extract([ref, alt1, alt2], a1 + 1) as y from m"
    " join v using (vid) where vid < 400)"
    ", k as (select vid, list(distinct b) as have from (select vid, unnest([x, y]) as b from l where x is not null and y is not null) group by 1)"
    ", ord as (select vid, [z for z in ['A', 'C', 'T', 'G'] if list_contains(have, z)] as al from k)"
)
NUMBERS = (
    " select chrom, cast(pos as int) as pos, cast(sid as int) as sample_idx, al[1] as ref, {x} as a0, {y} as a1 from l"
    " join ord using (vid) join v using (vid)"
)
POSITION = "cast(case when x is not null and y is not null then list_position(al, {0}) - 1 end as int)"


def _matrix_rows(v: Variations, cell, splitter) -> DataFrame:
    path, info = matrix(v.chunk(0, 400), "matrix", cell)
    got = matrix_text.read_matrix(v.df.sparkSession, path, info, splitter, ignore_empty_vars=True)
    rows = got.df.select("chrom", "pos", "ref", F.posexplode("calls").alias("sample_idx", "c"))
    return rows.select("chrom", "pos", "sample_idx", "ref", F.col("c.gt")[0].alias("a0"), F.col("c.gt")[1].alias("a1"))


query("matrix_two_letters", NUMBERED + NUMBERS.format(x=POSITION.format("x"), y=POSITION.format("y")))(lambda v: _matrix_rows(v, _pair, matrix_text.two_letters))
query(
    "matrix_iupac",
    NUMBERED + ", q as (" + NUMBERS.format(x=POSITION.format("x"), y=POSITION.format("y")) + ") select chrom, pos, sample_idx, ref, least(a0, a1) as lo, greatest(a0, a1) as hi from q",
)(lambda v: _matrix_rows(v, _code, matrix_text.iupac).select("chrom", "pos", "sample_idx", "ref", F.least("a0", "a1").alias("lo"), F.greatest("a0", "a1").alias("hi")))

# --- reads

LETTER = "substr('ACGT', cast(({0} * 7 + vid * 3 + {0} * {0}) % 4 as int) + 1, 1)"
SEQ = f"array_join(transform(sequence(0L, 19L), i -> {LETTER.format('i')}), '')"


def sam_text(v: Variations) -> str:
    """Two reads at each of some variants: one without gaps, one that begins with two clipped bases."""
    spark, path = v.df.sparkSession, place(v.df.sparkSession, "sam")
    head = spark.createDataFrame([(0, "@SQ\tSN:chr1\tLN:100000"), (1, "@RG\tID:g1\tSM:one"), (2, "@RG\tID:g2\tSM:two")], "i long, value string")
    rows = v.df.where("row_idx < 300").selectExpr("row_idx as vid", "pos").withColumn("seq", F.expr(SEQ))
    plain = rows.selectExpr("vid * 2 + 3 as i", "concat_ws('\t', concat('r', vid), '0', 'chr1', pos + 1, '60', '20M', '*', '0', '0', seq, '*', 'RG:Z:g1') as value")
    clipped = rows.selectExpr("vid * 2 + 4 as i", "concat_ws('\t', concat('c', vid), '0', 'chr1', pos + 1, '60', '2S18M', '*', '0', '0', seq, '*', 'RG:Z:g2') as value")
    head.unionByName(plain).unionByName(clipped).coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    return path


KMERS = (
    ", sq as (select vid, pos, string_agg(" + LETTER.format("i").replace("substr('ACGT', cast(", "substr('ACGT', cast(") + ", '' order by i) as seq from v, range(20) t(i) where vid < 300 group by 1, 2)"
    ", km as (select 'one' as sample, pos + i as pos, substr(seq, i + 1, 5) as kmer from sq, range(16) t(i) union all select 'two'"
    ", pos + i, substr(seq, i + 3, 5) from sq, range(14) t(i))"
)
query("sam_kmers", KMERS + " select 'chr1' as ref, cast(pos as bigint) as pos, sample, kmer, count(*) as n from km group by all")(
    lambda v: sam.read_kmers(v.df.sparkSession, [sam_text(v)], 5)
)
query("sam_covered", KMERS + (
    ", cu as (select pos, sample, count(*) as n from km group by 1, 2 having count(*) >= 2) select 'chr1' as ref"
    ", cast(pos as bigint) as pos, sample, kmer, count(*) as n from km where (pos, sample) in (select (pos, sample)"
    " from cu) and pos in (select pos from cu group by 1 having count(*) >= 2) group by all"
))(
    lambda v: sam.covered(sam.read_kmers(v.df.sparkSession, [sam_text(v)], 5), 2, 2)
)
query("sam_regions", KMERS + (
    " select 'chr1' as ref, cast(pos as bigint) as pos, sample, kmer, count(*) as n from km where pos >= 1000 and pos < 2000"
    " group by all"
))(
    lambda v: sam.read_kmers(v.df.sparkSession, [sam_text(v)], 5, regions=[("chr1", 1000, 2000)])
)

# --- the table

query("chunks", " select vid as row_idx, (vid - 100) // 300 as chunk from v where vid >= 100 and vid < 1500")(
    lambda v: v.chunks(300, 100, 1500).select("row_idx", "chunk")
)
query("by_chrom", " select chrom, count(*) as n, min(vid) as first from v where chrom in ('chr2', 'chr4') group by 1")(
    lambda v: _united([(chrom, t) for chrom, t in v.by_chrom(["chr4", "chr2", "none"])])
)


def _united(parts: list[tuple[str, Variations]]) -> DataFrame:
    out = None
    for chrom, t in parts:
        one = t.df.agg(F.lit(chrom).alias("chrom"), F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


query("put", (
    " , x as (select max(vid) + 1 as n from v) select vid as row_idx, chrom, qual from v union all select vid + n, chrom, null from v"
    ", x where vid < 50"
))(
    lambda v: v.put(v.df.where("row_idx < 50").drop("qual")).df.select("row_idx", "chrom", "qual")
)
query("copy", " select vid as row_idx, chrom, cast(pos as int) as pos, ref from v")(lambda v: v.copy(kept=["row_idx", "chrom", "pos", "ref"]).df)
query("region", " select vid as row_idx, cast(pos as int) as pos from v where chrom = 'chr2' and pos >= 500 and pos < 2500")(
    lambda v: v.region("chr2", 500, 2500).df.select("row_idx", "pos")
)
query("table_facts", " select count(*) as n, 2 as ploidy, (select string_agg(distinct chrom, ' ' order by chrom) from v) as chroms, 25 as samples from v")(
    lambda v: v.df.sparkSession.createDataFrame([(v.num_variations(), v.ploidy, " ".join(v.chroms()), len(v.samples))], "n long, ploidy int, chroms string, samples int")
)
query("renamed_samples", " select cast(sid as int) as sample_idx, concat('x', sid) as sample from s")(
    lambda v: v.rename_samples([f"x{i}" for i in range(25)]).sample_table().select("sample_idx", "sample")
)
query("sample_table", " select cast(sid as int) as sample_idx, sample, cast(pop as varchar) as pop from s")(lambda v: v.sample_table())
query("mock_depth", f" select vid as row_idx, {CALL}, 7 as dp from m")(lambda v: v.with_depth(7).long().select("row_idx", "sample_idx", "dp"))


def _round_trip(v: Variations) -> Variations:
    path = place(v.df.sparkSession, "store")
    v.write(path)
    return Variations.read(v.df.sparkSession, path)


query("store", f" select vid as row_idx, {CALL}, a0, a1, cast(dp as int) as dp from m")(
    lambda v: _round_trip(v).long().select("row_idx", "sample_idx", F.col("gt")[0].alias("a0"), F.col("gt")[1].alias("a1"), "dp")
)

# --- tables as text

query("stats_by_sample_text", (
    " select sample, round(count_if(called) / count(*), 8) as call_rate"
    ", round(count_if(het) / nullif(count_if(called), 0), 8) as heterozygosity from m join s using (sid) group by 1"
))(
    lambda v: _csv(v)
)


def _csv(v: Variations) -> DataFrame:
    path = place(v.df.sparkSession, "stats")
    table_sinks.write_stats_by_sample(v, path)
    rows = v.df.sparkSession.read.csv(path, sep="\t", header=True)
    return rows.select("sample", F.round(F.col("call_rate").cast("double"), 8).alias("call_rate"), F.round(F.col("heterozygosity").cast("double"), 8).alias("heterozygosity"))


query("curlywhirly", (
    " select i, line from (select -1 as i, concat_ws(chr(9), 'categories:pop', 'label', 'x', 'y') as line union all select sid"
    ", concat_ws(chr(9), pop, sample, sid, sid * 2) from s)"
))(
    lambda v: _lines(v, table_sinks.write_curlywhirly(v.samples, [(i, 2 * i) for i in range(len(v.samples))], ["x", "y"], {"pop": [next(p for p, m in v.populations.items() if s in m) for s in v.samples]}))
)


def _lines(v: Variations, text: str) -> DataFrame:
    return v.df.sparkSession.createDataFrame([(i - 1, x) for i, x in enumerate(text.splitlines())], "i long, line string")


query("excel_cells", (
    ", t as (select vid, sid, case when a0 is null or a1 is null then '' else list_extract([ref, alt1, alt2]"
    ", a0 + 1) || '/' || list_extract([ref, alt1, alt2], a1 + 1) end as cell from m join v using (vid) where vid < 60) select cell"
    ", count(*) as n from t group by 1"
))(
    lambda v: _cells(v)
)


def _cells(v: Variations) -> DataFrame:
    """How often each text stands in the workbook's genotype cells."""
    import os
    import re
    import tempfile
    import zipfile
    from collections import Counter

    with tempfile.TemporaryDirectory() as folder:  # a workbook is a file of the driver
        path = os.path.join(folder, "x.xlsx")
        table_sinks.write_excel(v.chunk(0, 60), path)
        sheet = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    rows = [re.findall(r"<t>([^<]*)</t>", r) for r in re.findall(r"<row>(.*?)</row>", sheet)[1:]]
    counts = Counter(x for r in rows for x in r[3:])
    return v.df.sparkSession.createDataFrame(sorted(counts.items()), "cell string, n long")


query("fasta_aligned_alleles", (
    ", t as (select vid, vid % 11 = 0 as long, ref, alt1 from v where vid < 300) select vid as row_idx"
    ", case when long then ref || '--' else ref end as ref, case when long then ref || 'AG' else alt1 end as alt from t"
))(
    lambda v: _aligned(v)
)


def _aligned(v: Variations) -> DataFrame:
    """Alleles of one length at each variant: insertions after the reference's base on every eleventh."""
    rows = v.df.where("row_idx < 300").select("row_idx", "ref", F.when(F.col("row_idx") % 11 == 0, F.concat("ref", F.lit("AG"))).otherwise(F.col("alt")[0]).alias("alt"))
    letters = fasta.one_length(F.array("ref", "alt"))
    return rows.select("row_idx", letters.alias("x")).select("row_idx", F.col("x")[0].alias("ref"), F.col("x")[1].alias("alt"))


# --- the command line

def _command_line(v: Variations) -> DataFrame:
    """Two stores from text and from a matrix, merged: how many variants and samples each has."""
    spark = v.df.sparkSession
    some = v.chunk(0, 200)
    one, two, both = (place(spark, x) for x in ("cli-vcf", "cli-matrix", "cli-both"))
    cli.main(["load", vcf_text(some), one])
    path, info = matrix(some.having(some.df.where("row_idx % 2 = 0"), samples=[f"{s}-2" for s in v.samples]), "cli-text", _pair)
    info_path = place(spark, "cli-info")
    info.write.csv(info_path, header=True)
    cli.main(["load-matrix", path, info_path, two])
    cli.main(["merge", one, two, both, "--ignore-complex", "--any-reference"])
    counts = [(name, Variations.read(spark, p)) for name, p in (("one", one), ("two", two), ("both", both))]
    return spark.createDataFrame([(name, t.num_variations(), len(t.samples)) for name, t in counts], "name string, n long, samples int")


query("command_line", (
    ", l as (select count(*) as n, count_if(vid % 2 = 0) as half from v where vid < 200 and vid > 0)"
    " select 'one' as name, (select count(*) from v where vid < 200) as n, 25 as samples union all select 'two', (select count(*)"
    " from v where vid < 200 and vid % 2 = 0), 25 union all select 'both', (select count(*) from v where vid < 200), 50"
))(
    _command_line
)


# --- the derived tables themselves

def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.samples(spark, sf_dir).groupBy("pop").agg(F.count(F.lit(1)).alias("n"))


QUERIES["populations"], ORACLES["populations"] = _facts, fixture.SQL + " select pop, count(*) as n from s group by 1"


def _tree(v: Variations) -> trees.Tree:
    """Of 25 samples: their distances are brought to the driver."""
    import numpy as np

    square = np.zeros((len(v.samples),) * 2)
    for r in distances.calc_kosman(v).collect():
        square[r.i, r.j] = square[r.j, r.i] = r.dist
    return trees.do_tree(square, v.samples, "upgma")


def _leaves(v: Variations) -> DataFrame:
    """The labels that a tree's file names, and in how many subtrees they are."""
    import re

    tree = _tree(v)
    text = trees.write_nexus(tree)
    groups = trees.get_subtrees(tree, 0.01)
    found = [(s, bool(re.search(rf"{re.escape(s)}", text)), sum(s in [x.name for x in t.leaves()] for t in groups)) for s in v.samples]
    return v.df.sparkSession.createDataFrame(found, "sample string, named boolean, subtrees int")


query("tree_leaves", " select sample, true as named, 1 as subtrees from s")(_leaves)


def bam_file(v: Variations) -> str:
    """The reads of ``sam_text`` as a binary file, written by the driver: a fixture of some hundred reads."""
    import os

    from pyarrow import fs

    spark, path = v.df.sparkSession, place(v.df.sparkSession, "bam")
    lines = [r.value for r in spark.read.text(sam_text(v)).collect()]
    store, folder = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/reads.bam", compression=None) as out:
        out.write(bam.encode(lines))
    return f"{path}/reads.bam"


query("bam_kmers", ORACLES["sam_kmers"].removeprefix(fixture.SQL))(lambda v: bam.read_kmers(v.df.sparkSession, [bam_file(v)], 5))
query("bam_regions", ORACLES["sam_regions"].removeprefix(fixture.SQL))(lambda v: bam.read_kmers(v.df.sparkSession, [bam_file(v)], 5, regions=[("chr1", 1000, 2000)]))

# --- arrays of a size

query("packets", " select vid // 300 as packet, count(*) as n, min(vid) as first, max(vid) as last from v group by 1")(
    lambda v: arrays.packets(v.df, "row_idx", 300).select("packet", F.size("members").cast("long").alias("n"), F.col("members")[0].alias("first"), F.element_at("members", -1).alias("last"))
)
query("packets_filled", " select vid // 300 as packet, 300 as n, 300 - count(*) as missing from v group by 1")(
    lambda v: arrays.packets(v.df, "row_idx", 300, filled=True).select("packet", F.size("members").alias("n"), F.size(F.filter("members", lambda x: x.isNull())).cast("long").alias("missing"))
)
query("resized_arrays", " select vid as row_idx, alt1 as one, alt2 as two, 'N' as three from v")(
    lambda v: v.df.select("row_idx", arrays.resized(F.col("alt"), 3, "N").alias("x")).select("row_idx", F.col("x")[0].alias("one"), F.col("x")[1].alias("two"), F.col("x")[2].alias("three"))
)
query("stacked_arrays", " select vid as row_idx, alt1 as one, alt2 as two from v where vid < 30 union all select vid, alt1, '' from v where vid >= 100 and vid < 150")(
    lambda v: arrays.stacked([v.chunk(0, 30).df.select("row_idx", "alt"), v.chunk(100, 150).df.select("row_idx", F.slice("alt", 1, 1).alias("alt"))], "alt", "").select(
        "row_idx", F.col("alt")[0].alias("one"), F.col("alt")[1].alias("two")
    )
)
