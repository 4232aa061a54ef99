"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..operators import distances, filters, histograms, linkage, merge, multivariate, ordering, populations, samples, transforms, variant_stats, windows
from ..operators.table import Variations
from ..sinks import fasta
from . import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Stores of the fixture by the folder that it was derived from; without one queries derive it themselves.
STORES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str) -> Variations:
    if sf_dir in STORES:
        return Variations.read(spark, STORES[sf_dir])
    names = fixture.names(spark, sf_dir)
    pops: dict[str, list[str]] = {}
    for _, name, pop in names:
        pops.setdefault(str(pop), []).append(name)
    return Variations(fixture.wide(spark, sf_dir), [n for _, n, _ in names], fixture.PLOIDY, pops)


def store(spark: SparkSession, sf_dir: str, path: str, parts: int) -> None:
    """Writes the fixture as a store of so many files, which queries on ``sf_dir`` read from then on."""
    v = load(spark, sf_dir)
    v.write(path, parts)
    STORES[sf_dir] = path


def query(name: str, sql: str | None = None):
    """Registers a function of a table; ``sql`` continues the common tables of the fixture."""

    def add(f: Callable[[Variations], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fixture.SQL + sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))  # no negative zero
    return df


CALLED = ", cd as (select vid, count_if(called) as m, count_if(het) as h from m group by vid)"
FREQ = CALLED + (
    ", fr as (select n.vid, allele, n, sum(n) over (partition by n.vid) as t from n)"
    ", st as (select vid, max(n) as big, min(t) as t, sum(pow(n / t, 2)) as p2, count(*) as k from fr group by vid)"
)

# --- statistics of variants

query("maf", FREQ + " select v.vid as row_idx, case when m >= 10 then big / t end as maf from v left join st using (vid) left join cd using (vid)")(variant_stats.calc_maf)
query("mac", FREQ + (
    " select v.vid as row_idx, case when m >= 10 then 25 - (t - big) / 2 end as mac from v left join st using (vid) left"
    " join cd using (vid)"
))(variant_stats.calc_mac)
query("maf_filter", FREQ + (
    " select v.vid as row_idx, chrom, pos, big / t as maf from v join st using (vid) join cd using (vid)"
    " where m >= 10 and big / t <= 0.95"
))(
    lambda v: filters.MafFilter(max_maf=0.95)(v).kept.df.select("row_idx", "chrom", F.col("pos").cast("long").alias("pos"), g.major_frequency(F.col("calls")).alias("maf"))
)
query(
    "ad_maf",
    ", x as (select vid, dp, cast(dp * (cast(coalesce(a0, 0) > 0 as int) + cast(coalesce(a1, 0) > 0 as int)) // 2 as bigint) as alt"
    " from g), y as (select vid, sum(dp - alt) as r, sum(alt) as a from x group by vid)"
    " select vid as row_idx, greatest(r, a) / (r + a) as maf from y",
)(variant_stats.calc_allele_observation_based_maf)
query("called_rate", CALLED + " select vid as row_idx, m / 25 as called from cd")(variant_stats.calc_called_gt)
query("missing_by_sample", (
    ", x as (select sid, count_if(not called) as k, count(*) as n from m group by sid) select cast(sid as int) as sample_idx"
    ", k / n as missing from x"
))(lambda v: variant_stats.calc_missing_gt(v, axis=0))
query("obs_het", CALLED + " select vid as row_idx, case when m >= 10 then h / m end as obs_het from cd")(variant_stats.calc_obs_het)
query("obs_het_by_depth", (
    ", x as (select vid, count_if(called and dp between 5 and 30) as m, count_if(het and dp between 5 and 30) as h from m group by vid)"
    " select vid as row_idx, case when m >= 10 then h / m end as obs_het from x"
))(
    lambda v: variant_stats.calc_obs_het(v, min_call_dp=5, max_call_dp=30)
)
query("exp_het", FREQ + (
    " select v.vid as row_idx, round(case when m >= 10 then 1 - p2 end, 8) as exp_het from v left join st using (vid) left"
    " join cd using (vid)"
))(lambda v: _rounded(variant_stats.calc_expected_het(v), "exp_het"))
query("unbiased_exp_het", FREQ + (
    " select v.vid as row_idx, round(case when m >= 10 then (1 - p2) * 2 * m / (2 * m - 1) end, 8) as exp_het from v left"
    " join st using (vid) left join cd using (vid)"
))(
    lambda v: _rounded(variant_stats.calc_unbias_expected_het(v), "exp_het")
)
query("unbiased_exp_het2", FREQ + (
    " select v.vid as row_idx, round(case when m >= 10 then (1 - p2) * m / (m - 1) end, 8) as exp_het from v left join st using (vid)"
    " left join cd using (vid)"
))(
    lambda v: _rounded(variant_stats.calc_unbias_expected_het2(v), "exp_het")
)
query("inbreeding", FREQ + (
    " select v.vid as row_idx, round(case when m >= 10 and p2 <> 1 then 1 - (h / m) / (1 - p2) end, 8) + 0.0 as inbreeding from v left"
    " join st using (vid) left join cd using (vid)"
))(
    lambda v: _rounded(variant_stats.calc_inbreeding_coef(v), "inbreeding")
)
query("allele_freq", FREQ + " select fr.vid as row_idx, allele, n / t as freq from fr join cd using (vid) where m >= 10")(variant_stats.calc_allele_freq)
query("allele_counts", " select vid as row_idx, allele, n from n")(variant_stats.calc_allele_counts)
query(
    "hwe",
    FREQ
    + ", k as (select vid from st where k = 2), q as (select vid, max(case when allele = 0 then n / t else 0 end) as p0"
    ", max(case when allele = 1 then n / t else 0 end) as p1 from fr group by vid)"
    ", o as (select vid, count_if(called and a0 = 0 and a1 = 0) as o0, count_if(called and least(a0, a1) = 0 and greatest(a0"
    ", a1) = 1) as o1, count_if(called and a0 = 1 and a1 = 1) as o2 from m group by vid)"
    ", e as (select *, (o0 + o1 + o2) * p0 as e0, (o0 + o1 + o2) * p1 * p1 as e1, (o0 + o1 + o2) * p1 as e2 from o join q using (vid)"
    " join k using (vid) join cd using (vid) where m >= 10)"
    " select vid as row_idx"
    ", round((o0 - e0) * (o0 - e0) / nullif(e0, 0) + (o1 - e1) * (o1 - e1) / nullif(e1, 0) + (o2 - e2) * (o2 - e2) / nullif(e2, 0), 6) as chi2, 2 as dof"
    " from e",
)(lambda v: _rounded(variant_stats.hwe(v), "chi2", digits=6))
query("singletons", " select v.vid as row_idx, coalesce(n.n, 0) = 1 as is_singleton from v left join n on v.vid = n.vid and allele = 1")(variant_stats.is_singleton)
query("doubletons", " select v.vid as row_idx, coalesce(n.n, 0) = 2 as is_doubleton from v left join n on v.vid = n.vid and allele = 1")(variant_stats.is_doubleton)
query("is_variant", " select v.vid as row_idx, exists (select 1 from n where n.vid = v.vid and allele > 0) as is_variant from v")(variant_stats.is_variant)
query("is_variable", (
    " select v.vid as row_idx, case when k > 0 then cast(k > 1 as int) end as is_variable from v left join (select vid, count(*) as k"
    " from n group by vid) using (vid)"
))(transforms.is_variable)
query("allele_frequency", FREQ + (
    " select v.vid as row_idx, coalesce(x.n / x.t, 0) as freq from v left join (select vid, n, t from fr"
    " where allele = 1) x using (vid)"
))(variant_stats.allele_frequency)
MAJOR = (
    ", mj as (select vid, allele as major from (select *, row_number() over (partition by vid order by n desc, allele) as r from n)"
    " where r = 1), ds as (select m.vid, sid, case when called then cast(a0 <> major as int) + cast(a1 <> major as int) end as dose"
    " from m left join mj using (vid))"
)
query("mat012", MAJOR + " select vid as row_idx, cast(sid as int) as sample_idx, dose from ds")(lambda v: transforms.gts_as_mat012(v).select("row_idx", F.posexplode("dose").alias("sample_idx", "dose")))

# --- filters

query("called_filter", CALLED + " select vid as row_idx from cd where m / 25 >= 0.9")(lambda v: filters.MinCalledGTsFilter(0.9)(v).kept.df.select("row_idx"))
query("no_missing_filter", CALLED + " select vid as row_idx from cd where m = 25")(lambda v: filters.NoMissingGTsFilter()(v).kept.df.select("row_idx"))
query("no_missing_or_het_filter", CALLED + " select vid as row_idx from cd where m = 25 and h = 0")(lambda v: filters.NoMissingGTsOrHetFilter()(v).kept.df.select("row_idx"))
query("het_filter", CALLED + " select vid as row_idx from cd where m >= 10 and h / m between 0.1 and 0.5")(lambda v: filters.ObsHetFilter(0.1, 0.5)(v).kept.df.select("row_idx"))
query("mac_filter", FREQ + " select vid as row_idx from st join cd using (vid) where m >= 10 and 25 - (t - big) / 2 <= 23")(lambda v: filters.MacFilter(max_mac=23)(v).kept.df.select("row_idx"))
query("qual_filter", " select vid as row_idx from v where qual >= 1000")(lambda v: filters.SNPQualFilter(1000)(v).kept.df.select("row_idx"))
REGION = "(chrom = 'chr1' or (chrom = 'chr2' and pos >= 500 and pos < 2500))"
REGIONS = [("chr1",), ("chr2", 500, 2500)]
query("region_filter", f" select vid as row_idx from v where {REGION}")(lambda v: filters.SNPPositionFilter(REGIONS)(v).kept.df.select("row_idx"))
query("region_anti", f" select vid as row_idx from v where not {REGION}")(lambda v: filters.SNPPositionFilter(REGIONS, reverse=True)(v).kept.df.select("row_idx"))
query("indel_filter", " select vid as row_idx from v where vid % 11 <> 0")(
    lambda v: filters.IndelFilter()(v.having(v.df.withColumn("alt", F.when(F.col("row_idx") % 11 == 0, F.array(F.concat("ref", F.lit("AG")))).otherwise(F.col("alt"))))).kept.df.select("row_idx")
)
query("biallelic_filter", FREQ + " select vid as row_idx from st where k = 2")(lambda v: filters.NonBiallelicFilter()(v).kept.df.select("row_idx"))
query("variable_filter", FREQ + " select vid as row_idx from st join cd using (vid) where k > 1 and m > 0")(lambda v: filters.VariableAndNotAllMissing()(v).kept.df.select("row_idx"))
query("or_filter", f" select vid as row_idx from v where qual >= 1000 or {REGION}")(lambda v: filters.OrFilter([filters.SNPQualFilter(1000), filters.SNPPositionFilter(REGIONS)])(v).kept.df.select("row_idx"))
query("density_filter", (
    ", d as (select vid, count(*) over (partition by chrom order by pos range between 150 preceding and 150 following) as d from v)"
    " select vid as row_idx from d where d <= 3"
))(
    lambda v: filters.filter_variation_density(v, 3, 301).df.select("row_idx")
)
query("filter_stats", CALLED + " select count_if(m / 25 >= 0.9) as n_kept, count_if(m / 25 < 0.9) as n_filtered_out, count(*) as tot from cd")(lambda v: filters.MinCalledGTsFilter(0.9)(v).stats)
query("low_dp_setter", (
    " select vid as row_idx, cast(sid as int) as sample_idx, case when dp >= 10 then a0 end as a0, case when dp >= 10 then a1 end as a1"
    ", cast(case when dp >= 10 then dp end as int) as dp from g"
))(
    lambda v: transforms.LowDPGTsToMissingSetter(10)(v).long().select("row_idx", "sample_idx", F.col("gt")[0].alias("a0"), F.col("gt")[1].alias("a1"), "dp")
)
query("low_gq_setter", (
    " select vid as row_idx, cast(sid as int) as sample_idx, case when gq >= 10 then a0 end as a0, case when gq >= 10 then a1 end as a1"
    " from g"
))(
    lambda v: transforms.LowQualGTsToMissingSetter(10)(v).long().select("row_idx", "sample_idx", F.col("gt")[0].alias("a0"), F.col("gt")[1].alias("a1"))
)
query("dup_allele_fix", (
    " select vid as row_idx, cast(sid as int) as sample_idx"
    ", case when vid % 3 = 0 and a0 = 1 then 0 when vid % 3 = 0 and a0 = 2 then 1 else a0 end as a0 from g"
))(
    lambda v: transforms.fix_duplicated_alleles(v.having(v.df.withColumn("alt", F.when(F.col("row_idx") % 3 == 0, F.array("ref", F.col("alt")[1])).otherwise(F.col("alt"))))).long().select("row_idx", "sample_idx", F.col("gt")[0].alias("a0"))
)

# --- histograms and windows

HIST = (
    ", b as (select cast(range as int) as bin from range(20))"
    ", w as (select min(maf) as lo, max(maf) as hi from x)"
    ", f as (select cast(least(floor((maf - lo) / ((hi - lo) / 20)), 19) as int) as bin, count(*) as n from x, w where maf is not null"
    " group by 1)"
)
XMAF = FREQ + ", x as (select case when m >= 10 then big / t end as maf from v left join st using (vid) left join cd using (vid))"
query("histogram", XMAF + HIST + (
    " select b.bin, lo + b.bin * ((hi - lo) / 20) as lo, lo + (b.bin + 1) * ((hi - lo) / 20) as hi, coalesce(n, 0) as n from b cross"
    " join w left join f on b.bin = f.bin"
))(
    lambda v: histograms.histogram_for_stat(v, variant_stats.calc_maf)
)
query("cumulative_hist", XMAF + HIST + (
    " select b.bin, coalesce(n, 0) as n, cast(sum(coalesce(n, 0)) over (order by b.bin desc) as bigint) as cum from b left"
    " join f on b.bin = f.bin"
))(
    lambda v: histograms.cumulative(histograms.histogram_for_stat(v, variant_stats.calc_maf)).select("bin", "n", "cum")
)
query(
    "called_by_depth",
    ", d as (select unnest([5, 10, 20]) as depth)"
    ", x as (select d.depth, vid, count_if(called and dp >= depth) as x from m, d group by d.depth, vid)"
    ", b as (select depth, cast(range as int) as bin from d, range(25))"
    ", f as (select depth, cast(least(floor(x / (26 / 25)), 24) as int) as bin, count(*) as n from x group by 1, 2) select depth, bin"
    ", coalesce(n, 0) as n from b left join f using (depth, bin)",
)(lambda v: histograms.called_by_depth(v, [5, 10, 20]).select("depth", "bin", "n"))
query(
    "dp_histogram_by_sample",
    ", b as (select cast(sid as int) as sample_idx, cast(range as int) as bin from s, range(20))"
    ", f as (select cast(sid as int) as sample_idx, cast(least(floor(dp / 2.0), 19) as int) as bin, count(*) as n from g group by 1, 2)"
    " select sample_idx, bin, coalesce(n, 0) as n from b left join f using (sample_idx, bin)",
)(lambda v: histograms.field_histogram(v, "dp", range_=(0, 40)).select("sample_idx", "bin", "n"))
query("hist2d_allele_observations", (
    ", x as (select dp - alt as x, alt as y from (select dp"
    ", cast(dp * (cast(coalesce(a0, 0) > 0 as int) + cast(coalesce(a1, 0) > 0 as int)) // 2 as bigint) as alt from m))"
    " select cast(least(floor(x / 2.0), 19) as int) as x_bin, cast(least(floor(y / 2.0), 19) as int) as y_bin, count(*) as n from x"
    " group by 1, 2"
))(
    lambda v: histograms.hist2d_allele_observations(v, 20, ((0, 40), (0, 40)))
)
query("snp_density", (
    " select vid as row_idx, chrom, cast(pos as int) as pos"
    ", count(*) over (partition by chrom order by pos range between 150 preceding and 150 following) as density from v"
))(lambda v: windows.calc_snp_density(v, 301))
STARTS = (
    ", e as (select chrom, min(pos) as a, max(pos) as b from v group by chrom)"
    ", st0 as (select chrom, a + i * 500 as win_start from e, range(0, 100000) t(i) where a + i * 500 < b)"
)
query("window_stat", CALLED + STARTS + (
    " select st0.chrom, win_start, coalesce(sum(m), 0) / 500.0 as stat from st0 left join (select chrom, pos, m from v"
    " join cd using (vid)) x on x.chrom = st0.chrom and pos >= win_start and pos < win_start + 500 group by 1, 2"
))(
    lambda v: windows.window_stat(v.df.select("chrom", "pos", g.n_called(F.col("calls")).cast("double").alias("stat")), 500)
)
query("sliding_window", (
    ", e as (select chrom, min(pos) as a, max(pos) as b from v group by chrom)"
    ", w as (select chrom, a + i * 250 as win_start from e, range(0, 200000) t(i) where a + i * 250 <= b) select w.chrom, win_start"
    ", count(*) as n from w join v on v.chrom = w.chrom and pos >= win_start and pos < win_start + 500 group by 1, 2"
))(
    lambda v: windows.iterate_wins(v, 500, 250).groupBy("chrom", "win_start").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "watterson",
    FREQ + ", e as (select chrom, min(pos) as a from v group by chrom)"
    ", x as (select chrom, a + 500 * ((pos - a) // 500) as win_start, k from v join e using (chrom) left join st using (vid))"
    ", h as (select sum(1.0 / i) as h from range(1, 50) t(i)) select chrom, cast(win_start as bigint) as win_start"
    ", round(count_if(k > 1) / 500.0, 8) as s, round(count_if(k > 1) / 500.0 / min(h), 8) as theta from x, h group by 1, 2",
)(lambda v: _rounded(windows.diversity_windows(v, 500).select("chrom", "win_start", "s", "theta"), "s", "theta"))
R = "case when n >= {least} and (n * sxx - sx * sx) * (n * syy - sy * sy) > 0 then (n * sxy - sx * sy) / sqrt(cast((n * sxx - sx * sx) * (n * syy - sy * sy) as double)) end"
PAIRSUM = (
    ", ps as (select p.a, p.b, count(*) as n, sum(x.dose) as sx, sum(y.dose) as sy, sum(x.dose * x.dose) as sxx"
    ", sum(y.dose * y.dose) as syy, sum(x.dose * y.dose) as sxy from p join ds x on x.vid = p.a"
    " join ds y on y.vid = p.b and x.sid = y.sid where x.dose is not null and y.dose is not null group by 1, 2)"
)
query("ld_pairs", MAJOR + ", p as (select a.vid as a, b.vid as b from v a join v b on a.chrom = b.chrom and b.pos > a.pos and b.pos - a.pos <= 250)" + PAIRSUM + f" select p.a, p.b, round(abs({R.format(least=10)}), 10) as r from p left join ps on p.a = ps.a and p.b = ps.b")(
    lambda v: _rounded(linkage.calc_ld_along_genome(v, 250, max_maf=None).select("a", "b", "r"), "r", digits=10)
)
query(
    "r2_windows",
    MAJOR + STARTS.replace("500", "400") + (
        ", iw as (select st0.chrom, win_start, vid from st0 join v on v.chrom = st0.chrom and pos > win_start and pos <= win_start + 400)"
        ", p as (select x.chrom, x.win_start, x.vid as a, y.vid as b from iw x"
        " join iw y on x.chrom = y.chrom and x.win_start = y.win_start and x.vid < y.vid)"
    )
    + PAIRSUM.replace("select p.a, p.b,", "select p.a, p.b,").replace("from p join", "from (select distinct a, b from p) p join")
    + f" select t.chrom, t.win_start, round(avg(r * r), 8) as r2 from (select distinct chrom, win_start from iw) t left join p on p.chrom = t.chrom and p.win_start = t.win_start left join (select a, b, {R.format(least=0)} as r from ps) q on p.a = q.a and p.b = q.b group by 1, 2",
)(lambda v: _rounded(windows.calc_r2_windows(v, 400), "r2"))

# --- samples and populations

query("gt_type_stats", (
    " select cast(sid as int) as sample_idx, count_if(called and a0 = 0 and a1 = 0) as hom_ref, count_if(het) as het"
    ", count_if(called and not het and a0 <> 0) as hom_alt, count_if(not called) as missing from m group by sid"
))(samples.calc_gt_type_stats)
query("obs_het_by_sample", (
    " select cast(sid as int) as sample_idx, count_if(het and dp >= 5) / nullif(count_if(called and dp >= 5), 0) as obs_het from m"
    " group by sid"
))(lambda v: samples.calc_obs_het_by_sample(v, 5))
query("stats_by_sample", (
    " select cast(sid as int) as sample_idx, count_if(called) / count(*) as called_rate"
    ", count_if(het) / nullif(count_if(called), 0) as obs_het, count_if(called and not het) / nullif(count_if(called), 0) as obs_hom"
    " from m group by sid"
))(samples.calc_stats_by_sample)
query("depth_mean_by_sample", " select cast(sid as int) as sample_idx, sum(dp) / count(*) as dp_mean from g group by sid")(samples.calc_depth_mean_by_sample)
POP = (
    ", pm as (select vid, pop, count_if(called) as m, count_if(het) as h, count_if(called and dp >= 20) as m20"
    ", count_if(het and dp >= 20) as h20, avg(case when called then cast(het as int) end) as ho from m group by vid, pop)"
    ", pn as (select vid, pop, allele, count(*) as n, sum(count(*)) over (partition by vid, pop) as t from a where allele is not null"
    " group by vid, pop, allele), pt as (select vid, pop, max(n) as big, min(t) as t, sum(pow(n / t, 2)) as p2, count(*) as k from pn"
    " group by vid, pop)"
)
query("n_alleles_pop", POP + (
    " select vid as row_idx, cast(pop as varchar) as pop, case when m >= 4 then coalesce(k, 0) else 0 end as n_alleles from pm left"
    " join pt using (vid, pop)"
))(lambda v: populations.calc_number_of_alleles(v, min_num_genotypes=4))
query(
    "private_alleles",
    POP + ", x as (select vid, allele, min(pop) as pop from pn group by vid, allele having count(*) = 1)"
    ", y as (select vid, sum(m) as m from pm group by vid)"
    ", z as (select vid, pop, count(*) as n from x group by vid, pop)"
    " select pm.vid as row_idx, cast(pm.pop as varchar) as pop"
    ", case when pm.m >= 4 and y.m - pm.m >= 4 then coalesce(n, 0) else 0 end as n_private from pm join y using (vid) left"
    " join z on z.vid = pm.vid and z.pop = pm.pop",
)(lambda v: populations.calc_number_of_private_alleles(v, min_num_genotypes=4))
query("pop_maf", POP + (
    " select vid as row_idx, cast(pop as varchar) as pop, case when m >= 4 then big / t end as maf from pm left join pt using (vid"
    ", pop)"
))(lambda v: populations.calc_major_allele_freq(v, min_num_genotypes=4))
query("pop_obs_het", POP + " select vid as row_idx, cast(pop as varchar) as pop, case when m20 >= 2 then h20 / m20 end as obs_het from pm")(lambda v: populations.calc_obs_het(v, min_num_genotypes=2))
query("pop_exp_het", POP + (
    " select vid as row_idx, cast(pop as varchar) as pop, round(case when m >= 4 then (1 - p2) * 2 * m / (2 * m - 1) end, 8) as exp_het"
    " from pm left join pt using (vid, pop)"
))(
    lambda v: _rounded(populations.calc_exp_het(v, min_num_genotypes=4), "exp_het")
)
query("pop_report", POP + (
    ", x as (select pop, case when m >= 4 then big / t end as maf from pm left join pt using (vid, pop)) select 'maf' as stat"
    ", cast(pop as varchar) as pop, round(avg(maf), 6) as mean, min(maf) as min, round(quantile_cont(maf, 0.25), 6) as q25"
    ", round(quantile_cont(maf, 0.5), 6) as median, round(quantile_cont(maf, 0.75), 6) as q75"
    ", max(maf) as max, 100 * (count_if(maf >= 0.95) / count(maf)) as almost_fixed, 100 * (count_if(maf < 0.7) / count(maf)) as highly_variable"
    " from x group by pop"
))(
    lambda v: _rounded(populations.pop_stats_report(v, min_num_genotypes=4).where("stat = 'maf'"), "mean", "q25", "median", "q75", digits=6)
)

# --- order

query("sort", " select vid as id, row_number() over (order by chrom, pos, vid) - 1 as row_idx from v")(lambda v: ordering.sort_variations(v).df.select(F.col("id").cast("long").alias("id"), "row_idx"))
query("chrom_index", (
    " select chrom, min(vid) as first_idx, max(vid) as last_idx, cast(min(pos) as int) as first_pos, cast(max(pos) as int) as last_pos"
    " from v group by chrom"
))(lambda v: ordering.PosIndex(v).ranges())
query("chunk", " select vid as row_idx, chrom from v where vid >= 50 and vid < 150")(lambda v: v.chunk(50, 150).df.select("row_idx", "chrom"))

# --- distances

KOS = (
    ", pr as (select x.sid as i, y.sid as j, case when x.a0 in (y.a0, y.a1) then 1 else 0 end + case when x.a1 in (y.a0"
    ", y.a1) then 1 else 0 end + case when y.a0 in (x.a0, x.a1) then 1 else 0 end + case when y.a1 in (x.a0"
    ", x.a1) then 1 else 0 end as sh, least(x.a0, x.a1) = least(y.a0, y.a1) and greatest(x.a0, x.a1) = greatest(y.a0, y.a1) as eq"
    " from m x join m y on x.vid = y.vid and x.sid < y.sid where x.called and y.called)"
)
query("kosman", KOS + (
    " select cast(i as int) as i, cast(j as int) as j"
    ", sum(case when sh = 0 then 2 when sh = 4 then 0 else 1 end) / (2 * count(*)) as dist, count(*) as n from pr group by 1, 2"
))(distances.calc_kosman)
query("matching", KOS + " select cast(i as int) as i, cast(j as int) as j, count_if(eq) / count(*) as dist, count(*) as n from pr group by 1, 2")(distances.calc_matching)
NEI = POP + (
    ", ok as (select vid, pop from pm where m >= 4)"
    ", f as (select pn.vid, pn.pop, allele, n / t as p from pn join ok on ok.vid = pn.vid and ok.pop = pn.pop)"
    ", pp as (select x.vid, x.pop as pop1, y.pop as pop2 from ok x join ok y on x.vid = y.vid and x.pop < y.pop)"
    ", xy as (select pop1, pop2, sum(a.p * b.p) as xy from pp join f a on a.vid = pp.vid and a.pop = pop1"
    " join f b on b.vid = pp.vid and b.pop = pop2 and a.allele = b.allele group by 1, 2)"
    ", sq as (select vid, pop, sum(p * p) as q from f group by 1, 2)"
)
query("nei", NEI + (
    ", ss as (select pop1, pop2, sum(a.q) as xx, sum(b.q) as yy from pp join sq a on a.vid = pp.vid and a.pop = pop1"
    " join sq b on b.vid = pp.vid and b.pop = pop2 group by 1, 2) select cast(pop1 as varchar) as pop1, cast(pop2 as varchar) as pop2"
    ", round(-ln(xy / sqrt(xx * yy)), 8) + 0.0 as dist from xy join ss using (pop1, pop2)"
))(
    lambda v: _rounded(distances.calc_nei(v, min_num_genotypes=4), "dist")
)
query("nei_unbiased", NEI + (
    ", ss as (select pop1, pop2, sum((10 * a.q - 1) / 9) as xx, sum((10 * b.q - 1) / 9) as yy from pp"
    " join sq a on a.vid = pp.vid and a.pop = pop1 join sq b on b.vid = pp.vid and b.pop = pop2 group by 1, 2)"
    " select cast(pop1 as varchar) as pop1, cast(pop2 as varchar) as pop2, round(greatest(0, -ln(xy / sqrt(xx * yy))), 8) + 0.0 as dist"
    " from xy join ss using (pop1, pop2)"
))(
    lambda v: _rounded(distances.calc_unbiased_nei(v, min_num_genotypes=4), "dist")
)
query(
    "dest",
    NEI + ", al as (select distinct pp.vid, pop1, pop2, allele from pp join f on f.vid = pp.vid and f.pop in (pop1, pop2))"
    ", mt as (select al.vid, al.pop1, al.pop2, 1 - sum(pow((coalesce(a.p, 0) + coalesce(b.p, 0)) / 2, 2)) as ht from al left"
    " join f a on a.vid = al.vid and a.pop = pop1 and a.allele = al.allele left"
    " join f b on b.vid = al.vid and b.pop = pop2 and b.allele = al.allele group by 1, 2, 3)"
    ", x as (select mt.pop1, mt.pop2"
    ", ht, ((1 - sa.q) + (1 - sb.q)) / 2 as hs, (pa.ho + pb.ho) / 2 as ho, 2 / (1 / pa.m + 1 / pb.m) as n from mt"
    " join sq sa on sa.vid = mt.vid and sa.pop = pop1 join sq sb on sb.vid = mt.vid and sb.pop = pop2"
    " join pm pa on pa.vid = mt.vid and pa.pop = pop1 join pm pb on pb.vid = mt.vid and pb.pop = pop2)"
    ", y as (select *, n / (n - 1) * (hs - ho / (2 * n)) as hs2 from x)"
    ", z as (select pop1, pop2, avg(hs2) as hs, avg(ht + hs2 / (2 * n) - ho / (4 * n)) as ht from y group by 1, 2)"
    " select cast(pop1 as varchar) as pop1, cast(pop2 as varchar) as pop2, round(2 * (ht - hs) / (1 - hs), 8) + 0.0 as dist from z",
)(lambda v: _rounded(distances.calc_dest(v, min_num_genotypes=4), "dist"))
query(
    "gst",
    ", x as (select vid, pop, dp"
    ", cast(dp * (cast(coalesce(a0, 0) > 0 as int) + cast(coalesce(a1, 0) > 0 as int)) // 2 as bigint) as alt from g)"
    ", y as (select vid, pop, sum(dp - alt) / nullif(sum(dp), 0) as r, sum(alt) / nullif(sum(dp), 0) as o from x group by 1, 2)"
    ", z as (select vid, avg(1 - r * r - o * o) as hs, 1 - avg(r) * avg(r) - avg(o) * avg(o) as ht, count(r) as k from y group by 1)"
    " select vid as row_idx, round(case when k < 5 then 0 else coalesce((ht - hs) / nullif(ht, 0), 0) end, 6) + 0.0 as gst from z",
)(lambda v: _rounded(distances.calc_gst_per_loci(v), "gst", digits=6))

# --- tests, merging, blocks, sequences

query("hwe_test", ORACLES["hwe"].removeprefix(fixture.SQL).replace(" as chi2, 2 as dof from e", (
    " as chi2"
    ", round(exp(-((o0 - e0) * (o0 - e0) / nullif(e0, 0) + (o1 - e1) * (o1 - e1) / nullif(e1, 0) + (o2 - e2) * (o2 - e2) / nullif(e2, 0)) / 2), 6) as pvalue"
    " from e"
)))(
    lambda v: _rounded(variant_stats.calc_hwe_chi2_test(v), "chi2", "pvalue", digits=6)
)
query(
    "tajima",
    ", x as (select vid, count(a0) as n from g group by vid)"
    ", al as (select vid, a0, count(*) as c from g where a0 is not null group by 1, 2)"
    ", h as (select vid, count(*) as k, 1 - sum(pow(c / n, 2)) as h, min(n) as n from al join x using (vid) group by vid)"
    " select count_if(k > 1) as seg_sites, round(sum(case when n > 1 then n / (n - 1) * h end), 6) as pi from h",
)(lambda v: _rounded(variant_stats.tajima(v, 0, haplotype=0).select("seg_sites", "pi"), "pi", digits=6))


def _second(v: Variations) -> Variations:
    """A second table: two thirds of the variants, some of them one base further on."""
    rows = v.df.where(F.col("row_idx") % 3 != 0).withColumn("pos", (F.col("pos") + F.col("row_idx") % 2).cast("int"))
    return v.having(rows, samples=[f"{s}-2" for s in v.samples])


query("overlap_groups", (
    ", u as (select chrom, pos, 1 as side from v union all select chrom, pos + vid % 2, 2 from v where vid % 3 <> 0)"
    ", r as (select *, dense_rank() over (partition by chrom order by pos) as grp from u) select chrom, grp as \"group\""
    ", count_if(side = 1) as n1, count_if(side = 2) as n2 from r group by 1, 2"
))(
    lambda v: merge.group_counts(v.df, _second(v).df)
)
query("merge", (
    ", u as (select chrom, pos from v union select chrom, pos + vid % 2 from v where vid % 3 <> 0) select chrom"
    ", cast(pos as int) as pos, 50 as n_samples from u"
))(
    lambda v: merge.merge(v, _second(v), check_ref_matches=False, ignore_complex_overlaps=True).df.select("chrom", "pos", F.size("calls").alias("n_samples"))
)
query(
    "gram_matrix",
    MAJOR + (
        ", d as (select vid, sid, coalesce(dose, -1) as d from ds)"
        ", x as (select vid, sid, d * 25 - sum(d) over (partition by vid) as x from d) select cast(a.sid as int) as i"
        ", cast(b.sid as int) as j, cast(sum(a.x * b.x) as bigint) as s from x a join x b on a.vid = b.vid and a.sid <= b.sid group by 1, 2"
    ),
)(multivariate.gram_matrix)
query("fasta", (
    " select cast(sid as int) as sample_idx, cast(hap as int) as hap, concat(sample, '_hap', cast(hap + 1 as varchar)) as name"
    ", string_agg(case when allele = 0 then ref when allele = 1 then alt1 when allele = 2 then alt2 else 'N' end, '' order by vid) as sequence"
    " from a join v using (vid) join s using (sid) group by 1, 2, 3"
))(
    fasta.sequences
)
query("pairs_in_range", (
    " select a.vid as a, b.vid as b, cast(b.pos - a.pos as int) as dist from v a"
    " join v b on a.chrom = b.chrom and b.pos > a.pos and b.pos - a.pos <= 250"
))(lambda v: linkage.iterate_pairs(v, 250))
query("field_value_filter", " select vid as row_idx from v where ref = 'A'")(lambda v: filters.FieldValueFilter("ref", "A")(v).kept.df.select("row_idx"))
query("sample_filter", " select vid as row_idx, count_if(called) as n from m where sid in (2, 5, 7) group by 1")(lambda v: variant_stats.calc_called_gt(filters.SamplesFilterByIndex([2, 5, 7])(v), rates=False).withColumnRenamed("called", "n"))
query("samples_by_called_rate", " select cast(sid as int) as sample_idx from m group by 1 having avg(cast(called as int)) > 0.9")(
    lambda v: v.df.sparkSession.createDataFrame([(v.samples.index(s),) for s in filters.filter_samples_by_missing_rate(v, 0.9).samples], "sample_idx int")
)


from . import calls, relations, tables  # noqa: E402, F401 - they register their queries here
