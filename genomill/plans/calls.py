"""Queries on calls and variants: statistics, filters, setters, histograms, populations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, histograms, pipeline, plots, populations, samples, transforms, variant_stats, windows
from ..operators.table import Variations
from .registry import CALLED, FREQ, POP, STARTS, _rounded, query

ALT = "cast(dp * (cast(coalesce(a0, 0) > 0 as int) + cast(coalesce(a1, 0) > 0 as int)) // 2 as bigint)"
READS = f", rd as (select vid, sid, pop, dp, gq, a0, a1, called, het, dp - {ALT} as r, {ALT} as o from m)"
CALL = "select vid as row_idx, cast(sid as int) as sample_idx"


def by_sample(df: DataFrame, name: str) -> DataFrame:
    return df.select("row_idx", F.posexplode(name).alias("sample_idx", name))


# --- genotypes of calls

query("call_is_het", f" {CALL}, coalesce(het, false) as het from m")(lambda v: by_sample(variant_stats.call_is_het(v), "het"))
query("call_is_hom", f" {CALL}, coalesce(called and not het and dp between 5 and 30, false) as hom from m")(
    lambda v: by_sample(variant_stats.call_is_hom(v, 5, 30), "hom")
)
query("call_is_hom_ref", f" {CALL}, coalesce(called and not het and a0 = 0, false) as hom_ref from m")(
    lambda v: by_sample(variant_stats.call_is_hom_ref(v), "hom_ref")
)
query("call_is_hom_alt", f" {CALL}, coalesce(called and not het and a0 <> 0, false) as hom_alt from m")(
    lambda v: by_sample(variant_stats.call_is_hom_alt(v), "hom_alt")
)
query(
    "allele_freq_by_depth",
    READS
    + ", x as (select vid, sum(r) as r, sum(o) as o from rd group by vid)"
    " select vid as row_idx, cast(allele as int) as allele, case when allele = 0 then r else o end / nullif(r + o, 0) as freq"
    " from x, (select unnest([0, 1]) as allele)",
)(variant_stats.calc_allele_freq_by_depth)
query("maf_depth", READS + f" {CALL}, case when r + o >= 10 then greatest(r, o) / (r + o) end as maf_depth from rd")(variant_stats.calc_maf_depth)
query("depth", f" {CALL}, cast(dp as int) as dp from m")(variant_stats.calc_depth)
query("genotype_qual", f" {CALL}, cast(gq as int) as gq from m")(variant_stats.calc_genotype_qual)
query("is_non_variant", " select vid as row_idx, not exists (select 1 from n where n.vid = v.vid and allele > 0) as is_non_variant from v")(
    variant_stats.is_non_variant
)
query("count_variant", " select count(distinct vid) as n from n where allele > 0")(variant_stats.count_variant)
query("count_non_variant", " select count(*) as n from v where vid not in (select vid from n where allele > 0)")(variant_stats.count_non_variant)
query("count_singleton", " select count(*) as n from n where allele = 1 and n.n = 1")(variant_stats.count_singleton)
query("count_doubleton", " select count(*) as n from n where allele = 1 and n.n = 2")(variant_stats.count_doubleton)
query("allele_number", " select v.vid as row_idx, cast(coalesce(sum(n.n), 0) as bigint) as n from v left join n using (vid) group by 1")(
    variant_stats.allele_number
)
query("allele_count", " select v.vid as row_idx, coalesce(n.n, 0) as n from v left join n on v.vid = n.vid and allele = 2")(
    lambda v: variant_stats.allele_count(v, 2)
)
query("row_value_counter", " select v.vid as row_idx, coalesce(n.n, 0) as n from v left join n on v.vid = n.vid and allele = 0")(
    lambda v: variant_stats.row_value_counter(v, 0)
)
query("row_value_ratio", " select v.vid as row_idx, coalesce(n.n, 0) / 50 as n from v left join n on v.vid = n.vid and allele = 0")(
    lambda v: variant_stats.row_value_counter(v, 0, ratio=True)
)
query("harmonic_numbers", " select cast(n as int) as n, round(sum(1.0 / i), 10) as a1 from range(2, 60) t(n), range(1, 60) u(i) where i < n group by 1")(
    lambda v: v.df.sparkSession.createDataFrame([(n, round(variant_stats.a1(n), 10)) for n in range(2, 60)], "n int, a1 double")
)

# --- filters of variants

query(
    "ad_maf_filter",
    READS + (
        ", x as (select vid, sum(r) as r, sum(o) as o from rd group by vid) select vid as row_idx from x where greatest(r"
        ", o) / nullif(r + o, 0) <= 0.8"
    ),
)(lambda v: filters.AlleleObservationBasedMafFilter(max_maf=0.8)(v).kept.df.select("row_idx"))

# What chi-squared exceeds in one case of twenty, for 1 to 5 degrees of freedom.
CRITICAL = "[3.841458820694124, 5.991464547107979, 7.814727903251179, 9.487729036781154, 11.070497693516351]"
query(
    "chi2_filter",
    ", q as (select vid, sid < 12 as side, least(a0, a1) as x, greatest(a0, a1) as y from m where called)"
    ", k as (select vid, side, x, y, count(*) as n from q group by all)"
    ", kinds as (select distinct vid, x, y from k)"
    ", cells as (select vid, x, y, side, coalesce(n, 0) as n from kinds cross join (select unnest([true, false]) as side) left"
    " join k using (vid, side, x, y))"
    ", t as (select *, sum(n) over (partition by vid, side) as r, sum(n) over (partition by vid, x, y) as c"
    ", sum(n) over (partition by vid) as w, count(*) over (partition by vid) // 2 - 1 as freedom from cells)"
    ", p as (select vid, min(freedom) as freedom, min(r) as r, sum(pow(abs(n - r * c / w) - case when freedom = 1 then least(0.5"
    ", abs(n - r * c / w)) else 0 end, 2) / nullif(r * c / w, 0)) as chi2 from t group by vid)"
    f" select vid as row_idx from p where r > 0 and (freedom = 0 or chi2 <= list_extract({CRITICAL}, cast(freedom as int)))",
)(lambda v: filters.Chi2GtFreqs2SampleSetsFilter(v.samples[:12], v.samples[12:], 0.05)(v).kept.df.select("row_idx"))
QUANTILE = (
    ", qt as (select min(k) as k from (select k, sum(exp(-18.0) * pow(18.0, k) / gamma(k + 1)) over (order by k) as p"
    " from range(0, 100) t(k)) where p >= 0.9)"
)
query(
    "pseudo_het_filter",
    QUANTILE + ", x as (select vid, count_if(dp > k) / nullif(count_if(dp > 0), 0) as high, count_if(het) / nullif(count_if(called), 0) as het"
    " from m, qt group by vid)"
    " select vid as row_idx from x where not coalesce(high > 0.3 and het > 0.2, false)",
)(lambda v: filters.PseudoHetDuplicationFilter([18.0] * 25, 0.3, 0.2, 10)(v).kept.df.select("row_idx"))
query(
    "pseudo_het_filter2",
    QUANTILE + (
        ", x as (select vid, count_if(dp > k and het) / nullif(count_if(dp > 0), 0) as high from m, qt group by vid) select vid as row_idx"
        " from x where high <= 0.1"
    ),
)(lambda v: filters.PseudoHetDuplicationFilter2([18.0] * 25, 0.1, 10)(v).kept.df.select("row_idx"))
query("field_filter", " select vid as row_idx, chrom, cast(pos as int) as pos, qual from v")(
    lambda v: filters.FieldFilter(kept_fields=["row_idx", "chrom", "pos", "qual"])(v).df
)
query("field_filter_ignored", " select vid as row_idx, chrom, cast(pos as int) as pos, cast(vid as varchar) as id from v")(
    lambda v: filters.FieldFilter(ignored_fields=["ref", "alt", "qual", "calls"])(v).df
)
query("named_sample_filter", f" {CALL}, cast(dp as int) as dp from m join s using (sid) where sample not in ('NATION_2', 'NATION_18')".replace("cast(sid as int)", "cast(sid - (sid > 2)::int - (sid > 18)::int as int)"))(
    lambda v: filters.SampleFilter(["NATION_2", "NATION_18"], reverse=True)(v).long().select("row_idx", "sample_idx", "dp")
)
query("sampling_filter", " select cast(round(count(*) * 0.3) as bigint) as n, count(*) as tot from v")(
    lambda v: filters.VarsSamplingFilter(0.3)(v).stats.select(F.col("n_kept").alias("n"), "tot")
)
query("sampling_filter_number", " select cast(77 as bigint) as n, count(*) - 77 as rest from v")(
    lambda v: filters.VarsSamplingFilter2(77)(v).stats.select(F.col("n_kept").alias("n"), F.col("n_filtered_out").alias("rest"))
)
query("filter_histogram", CALLED + (
    ", f as (select cast(least(floor((m / 25) / 0.05), 19) as int) as bin, count(*) as n from cd group by 1)"
    " select cast(range as int) as bin, coalesce(n, 0) as n from range(20) b left join f on b.range = f.bin"
))(
    lambda v: filters.MinCalledGTsFilter(0.9, range_=(0, 1))(v).histogram.select("bin", "n")
)
query(
    "pipeline_stats",
    FREQ + ", one as (select cd.vid, m / 25 >= 0.9 as ok, big / t <= 0.9 and m >= 10 as good from cd left join st using (vid))"
    " select 'called' as name, 0 as \"order\", count_if(ok) as n_kept, count_if(not ok) as n_filtered_out, count(*) as tot from one"
    " union all select 'maf', 2, count_if(ok and coalesce(good, false)), count_if(ok and not coalesce(good, false)), count_if(ok) from one",
)(lambda v: _pipeline(v)[1])
query(
    "pipeline_result",
    FREQ + " select vid as row_idx, cast(sid as int) as sample_idx, case when gq >= 10 then a0 end as a0 from g join cd using (vid) join lateral"
    " (select big / t as maf from st where st.vid = g.vid) x on true where m / 25 >= 0.9 and m >= 10 and maf <= 0.9",
)(lambda v: _pipeline(v)[0].long().select("row_idx", "sample_idx", F.col("gt")[0].alias("a0")))


def _pipeline(v: Variations) -> tuple[Variations, DataFrame]:
    steps = pipeline.Pipeline().append(filters.MinCalledGTsFilter(0.9), "called").append(_counted, "count")
    steps.append(filters.MafFilter(max_maf=0.9), "maf").append(transforms.LowQualGTsToMissingSetter(10), "gq")
    out, results = steps.run(v)
    return out, steps.stats(results)


def _counted(v: Variations) -> DataFrame:
    return v.df.agg(F.count(F.lit(1)).alias("n"))


# --- changes of calls

query("is_variable_annotation", (
    " select v.vid as row_idx, case when k > 0 then cast(k > 1 as int) end as seen from v left join (select vid, count(distinct a) as k"
    " from (select vid, unnest([a0, a1]) as a from m where sid < 5) where a is not null group by vid) using (vid)"
))(
    lambda v: transforms.IsVariableAnnotator("seen", v.samples[:5])(v).df.select("row_idx", "seen")
)
query(
    "change_strand",
    " select vid as row_idx, case when vid % 3 = 0 then translate(ref, 'ACGT', 'TGCA') else ref end as ref,"
    " case when vid % 3 = 0 then translate(alt1 || alt2, 'ACGT', 'TGCA') else alt1 || alt2 end as alt from v",
)(lambda v: transforms.change_strand(v, v.df.select("row_idx", (F.col("row_idx") % 3 == 0).alias("flip"))).df.select("row_idx", "ref", F.array_join("alt", "").alias("alt")))
STRANDS = [("vid % 2 = 0", "row_idx % 2 = 0"), ("true", "true"), ("vid % 5 = 1", "row_idx % 5 = 1")]
query(
    "compatible_snps",
    ", x as (select vid, case vid % 3 when 0 then 'ACG' when 1 then 'CGT' else 'ACGT' end as here from v where vid < 150)"
    ", y as (select v.vid, len(translate(ref || alt1 || alt2, here, '')) = 0 as same, len(translate(ref || alt1 || alt2"
    ", translate(here, 'ACGT', 'TGCA'), '')) = 0 as turned from x join v using (vid))"
    + " union all".join(f" select {i} as strand, count_if(case when {sql} then same else turned end) as n, count(*) as checked from y" for i, (sql, _) in enumerate(STRANDS)),
)(
    lambda v: transforms.count_compatible_snps(
        v,
        v.df.where("row_idx < 150").select(
            "row_idx",
            F.split(F.when(F.col("row_idx") % 3 == 0, "ACG").when(F.col("row_idx") % 3 == 1, "CGT").otherwise("ACGT"), "").alias("alleles"),
            F.array(*[F.expr(e) for _, e in STRANDS]).alias("like_reference"),
        ),
    )
)
query(
    "set_random_missing",
    (
        ", x as (select vid // 600 as chunk, count_if(called) as n, count(*) as total from m group by 1) select chunk"
        ", cast(total - n + round_even(n * 0.25, 0) as bigint) as missing from x"
    ),
)(lambda v: variant_stats.calc_missing_gt(transforms.set_random_missing(v, 0.25), rates=False).groupBy(F.floor(F.col("row_idx") / 600).alias("chunk")).agg(F.sum("missing").alias("missing")))


def _drawn(n: int, ploidy: int = 2) -> list[int]:
    import random

    draw = random.Random(0)
    return [draw.randrange(ploidy) for _ in range(n)]


query("random_haploid_gts", f" {CALL}, case when list_extract({_drawn(25)}, cast(sid as int) + 1) = 0 then a0 else a1 end as hap from m")(
    lambda v: by_sample(transforms.random_haploid_gts(v), "hap")
)

# --- distributions

OBSERVED = READS + ", b as (select vid, gq, least(floor(r / 2.0), 19) as x, least(floor(o / 2.0), 19) as y from rd where r <= 40 and o <= 40)"
query("hist2d_gq_allele_observations", OBSERVED + " select cast(x as int) as x_bin, cast(y as int) as y_bin, round(avg(gq), 8) as mean from b group by 1, 2")(
    lambda v: _rounded(histograms.hist2d_gq_allele_observations(v, 20, ((0, 40), (0, 40))), "mean")
)
query(
    "hist2d_het_allele_freq",
    CALLED + ", x as (select vid, unnest([a0, a1]) as a from m where called)"
    ", y as (select vid, a, count(*) as n from x group by 1, 2)"
    ", z as (select vid, max(n) / sum(n) as f from y group by 1)"
    " select cast(least(floor(f / 0.05), 19) as int) as x_bin, cast(19 - least(floor((h / m) / 0.05), 19) as int) as y_bin"
    ", count(*) as n from z join cd using (vid) where m >= 10 group by 1, 2",
)(lambda v: histograms.hist2d_het_allele_freq(v, 20, (0, 1), (0, 1)))
BINS = ", b as (select cast(range as int) as bin from range({n}))"
query("gq_distribution_of_sample", BINS.format(n=20) + (
    ", f as (select cast(least(floor(gq / 3.0), 19) as int) as bin, count(*) as n from g where sid = 4 and gq <= 60 group by 1)"
    " select 4 as sample_idx, bin, coalesce(n, 0) as n from b left join f using (bin)"
))(
    lambda v: histograms.field_histogram(v, "gq", 20, (0, 60), v.samples[4]).select("sample_idx", "bin", "n")
)
query("maf_depth_histograms", READS + BINS.format(n=40) + (
    ", x as (select sid, greatest(r, o) / (r + o) as f from rd where r + o >= 10)"
    ", f as (select sid, cast(least(floor(f / 0.025), 39) as int) as bin, count(*) as n from x group by 1, 2)"
    " select cast(s.sid as int) as sample_idx, b.bin, coalesce(n, 0) as n from s cross join b left"
    " join f on f.sid = s.sid and f.bin = b.bin"
))(
    lambda v: histograms.maf_depth_histograms(v).select("sample_idx", "bin", "n")
)
query("call_dp_histograms", BINS.format(n=20) + (
    ", k as (select unnest(['hom', 'het']) as kind)"
    ", f as (select case when het then 'het' else 'hom' end as kind, cast(least(floor(dp / 2.0), 19) as int) as bin, count(*) as n"
    " from m where called and sid = 3 group by 1, 2) select kind, bin, coalesce(n, 0) as n from k cross join b left join f using (kind"
    ", bin)"
))(
    lambda v: histograms.call_dp_histograms(v, v.samples[3], (0, 40)).select("kind", "bin", "n")
)
query("depth_histograms_by_sample", BINS.format(n=20) + (
    ", k as (select unnest(['all', 'called', 'het', 'hom']) as kind)"
    ", x as (select sid, dp, unnest([y for y in ['all', case when called then 'called' end, case when het then 'het' end"
    ", case when called and not het then 'hom' end] if y is not null]) as kind from m)"
    ", f as (select kind, sid, cast(least(floor(dp / 2.0), 19) as int) as bin, count(*) as n from x group by all) select kind"
    ", cast(s.sid as int) as sample_idx, bin, coalesce(n, 0) as n from k cross join s cross join b left join f using (kind, sid, bin)"
))(
    lambda v: samples.depth_histograms_by_sample(v, (0, 40)).select("kind", "sample_idx", "bin", "n")
)
HISTOGRAM = BINS.format(n=40) + ", h as (select bin, bin + 0.5 as x, count(dp) as n from b left join m on m.dp = b.bin group by 1)"
query(
    "percentiles",
    HISTOGRAM + ", cu as (select *, sum(n) over (order by bin) / sum(n) over () as f from h)"
    ", w as (select *, lag(f) over (order by bin) as f0, lag(x) over (order by bin) as x0 from cu)"
    ", q as (select unnest([0.25, 0.5, 0.75]) as share) select cast(share as double) as share"
    ", round(min(case when f0 is null and share <= f then x when share > f0 and share <= f then x0 + (x - x0) * (share - f0) / (f - f0) end), 8) as value"
    " from q, w group by 1",
)(lambda v: _rounded(histograms.percentiles_of(histograms.histogram_of(v.long().select(F.col("dp").alias("x")), 40, (0, 40))), "value"))
query(
    "boxplot",
    HISTOGRAM + ", cu as (select *, sum(n) over (order by bin) as cum, sum(n) over () as t from h)"
    ", z as (select min(x) filter (cum >= 0.05 * t) as p5, min(x) filter (cum >= 0.25 * t) as q1, min(x) filter (cum >= 0.5 * t) as med"
    ", min(x) filter (cum >= 0.75 * t) as q3, min(x) filter (cum >= 0.95 * t) as p95, sum(x * n) / sum(n) as mean, min(t) as t from cu)"
    " select cast(p5 as double) as p5, cast(q1 as double) as q1, cast(med as double) as med, cast(q3 as double) as q3"
    ", cast(p95 as double) as p95, round(mean, 8) as mean, round(med - 1.57 * (q3 - q1) / sqrt(t), 8) as cilo"
    ", round(med + 1.57 * (q3 - q1) / sqrt(t), 8) as cihi from z",
)(lambda v: _rounded(histograms.boxplot_of(histograms.histogram_of(v.long().select(F.col("dp").alias("x")), 40, (0, 40))).drop("n"), "mean", "cilo", "cihi"))
query("min_max", FREQ + " select min(big / t) as lo, max(big / t) as hi from st join cd using (vid) where m >= 10")(
    lambda v: histograms.min_max(variant_stats.calc_maf(v), "maf")
)

# --- tracks

query("wig_track", CALLED + (
    " select chrom, 0 as k, cast(0 as bigint) as pos, concat('variableStep chrom=', chrom) as value from v group by chrom union all"
    " select chrom, 1, pos, concat(pos, ' ', cast(m as double)) from v join cd using (vid)"
))(
    lambda v: windows.to_wig(_called(v))
)
STAT = CALLED + STARTS + (
    ", w as (select st0.chrom, win_start, coalesce(sum(m), 0) / 500.0 as stat from st0 left join (select chrom, pos, m from v"
    " join cd using (vid)) x on x.chrom = st0.chrom and pos >= win_start and pos < win_start + 500 group by 1, 2)"
)
query("wig_track_windows", STAT + (
    " select chrom, 0 as k, cast(0 as bigint) as pos, concat('fixedStep chrom=', chrom, ' start='"
    ", min(win_start), ' span=500 step=500') as value from w group by chrom union all select chrom, 1, cast(win_start as bigint)"
    ", cast(cast(stat as double) as varchar) from w"
))(
    lambda v: windows.to_wig(_called(v), 500)
)
query("bedgraph_track", STAT + (
    " select chrom, cast(win_start as bigint) as pos, concat_ws(' ', chrom, win_start, win_start + 500, cast(stat as double)) as value"
    " from w"
))(
    lambda v: windows.to_bedgraph(_called(v), 500)
)


def _called(v: Variations) -> DataFrame:
    from ..functions import genotype as g

    return v.df.select("chrom", "pos", g.n_called(F.col("calls")).cast("double").alias("stat"))


# --- populations

query("n_alleles_and_called", POP + (
    " select vid as row_idx, cast(pop as varchar) as pop, case when m >= 4 then coalesce(k, 0) else 0 end as n_alleles, m as n_called"
    " from pm left join pt using (vid, pop)"
))(
    lambda v: populations.calc_number_of_alleles_and_number_called_gts(v, min_num_genotypes=4)
)
query("pop_stats", POP + (
    " select vid as row_idx, cast(pop as varchar) as pop, case when m >= 4 then coalesce(k, 0) else 0 end as n_alleles"
    ", case when m >= 4 then big / t end as maf from pm left join pt using (vid, pop)"
))(
    lambda v: populations.calc_pop_stats(v, ["n_alleles", "maf"], min_num_genotypes=4)
)

# --- the numbers behind plots

query("plot_histogram", BINS.format(n=20) + (
    ", f as (select cast(least(floor(gq / 3.0), 19) as int) as bin, count(*) as n from g group by 1) select bin, coalesce(n, 0) as n"
    " from b left join f using (bin)"
))(
    lambda v: plots.histogram(v.long().select(F.col("gq").alias("x")), 20, (0, 60)).select("bin", "n")
)
query("plot_stacked_histograms", BINS.format(n=20) + (
    ", k as (select distinct chrom from v), f as (select chrom, cast(least(floor(qual / 200), 19) as int) as bin, count(*) as n from v"
    " where qual <= 4000 group by 1, 2), h as (select chrom, bin, coalesce(n, 0) as n from k cross join b left join f using (chrom"
    ", bin)) select chrom, bin, n, cast(sum(n) over (partition by bin order by chrom) - n as bigint) as base from h"
))(
    lambda v: plots.stacked_histograms(v.df.select("chrom", F.col("qual").alias("x")), ["chrom"], 20, (0, 4000)).select("chrom", "bin", "n", "base")
)
query("plot_barplot", (
    ", t as (select cast(sid as int) as sample_idx, unnest(['called', 'missing']) as name, unnest([count_if(called)"
    ", count_if(not called)]) as value from m group by sid) select sample_idx, name, value"
    ", cast(case when name = 'missing' then sum(value) over (partition by sample_idx) - value else 0 end as bigint) as base from t"
))(
    lambda v: plots.barplot(
        samples.calc_gt_type_stats(v).select("sample_idx", F.explode(F.create_map(F.lit("called"), F.col("hom_ref") + F.col("het") + F.col("hom_alt"), F.lit("missing"), F.col("missing"))).alias("name", "value")),
        ["sample_idx"],
    )
)
query("plot_hist2d_margin", OBSERVED + " select cast(x as int) as x_bin, count(*) as n from b group by 1")(
    lambda v: plots.hist2d_margins(histograms.hist2d_allele_observations(v, 20, ((0, 40), (0, 40))))[0]
)
query("plot_manhattan", (
    ", e as (select chrom, max(pos) as e from v group by 1)"
    ", o as (select chrom, coalesce(sum(e + 100) over (order by chrom rows between unbounded preceding and 1 preceding), 0) as before"
    ", cast((row_number() over (order by chrom) - 1) % 2 as int) as colour from e) select vid as row_idx"
    ", cast(pos + before as bigint) as x, colour from v join o using (chrom)"
))(
    lambda v: plots.manhattan(v.df.select("row_idx", "chrom", "pos"), 100).select("row_idx", F.col("x").cast("long").alias("x"), "colour")
)
query("plot_boxplot", HISTOGRAM.replace("h as (select bin, bin + 0.5 as x, count(dp) as n from b left join m on m.dp = b.bin group by 1)", (
    "k as (select cast(sid as int) as sample_idx, bin + 0.5 as x, count(m.sid) as n from s cross join b left join m using (sid)"
    " where dp = bin group by 1, 2)"
)) + (
    ", cu as (select *, sum(n) over (partition by sample_idx order by x) as cum, sum(n) over (partition by sample_idx) as t from k)"
    " select sample_idx, cast(min(x) filter (cum >= 0.25 * t) as double) as q1, cast(min(x) filter (cum >= 0.5 * t) as double) as med"
    ", cast(min(x) filter (cum >= 0.75 * t) as double) as q3 from cu group by 1"
))(
    lambda v: plots.boxplot(v.long().select("sample_idx", F.col("dp").alias("x")), ["sample_idx"], 40, (0, 40)).select("sample_idx", "q1", "med", "q3")
)
query("plot_sample_missing_het", (
    " select cast(sid as int) as sample_idx, sample, count_if(not called) / count(*) as missing"
    ", count_if(het) / nullif(count_if(called), 0) as obs_het from m join s using (sid) group by 1, 2"
))(
    plots.sample_missing_het
)
query("plot_boxplot_series", BINS.format(n=60) + (
    ", k as (select 'dp' as series, bin + 0.5 as x, count(m.vid) as n from b left join m on dp = bin group by all union all select 'gq'"
    ", bin + 0.5, count(m.vid) from b left join m on gq = bin group by all)"
    ", cu as (select *, sum(n) over (partition by series order by x) as cum, sum(n) over (partition by series) as t from k)"
    " select series, cast(min(x) filter (cum >= 0.25 * t) as double) as q1, cast(min(x) filter (cum >= 0.5 * t) as double) as med"
    ", cast(min(x) filter (cum >= 0.75 * t) as double) as q3 from cu group by 1"
))(
    lambda v: plots.boxplots_of_series({f: histograms.histogram_of(v.long().select(F.col(f).alias("x")), 60, (0, 60)) for f in ("dp", "gq")}).select("series", "q1", "med", "q3")
)
query("plot_sample_depths", " select cast(sid as int) as sample_idx, count_if(called and not het) as n from m group by 1")(
    lambda v: plots.sample_depths(v, (0, 40)).where("kind = 'hom'").groupBy("sample_idx").agg(F.sum("n").alias("n"))
)
query("plot_qq", CALLED + (
    " select count(*) as n, round(sum(h), 6) as sum_x, round(sum((r - 0.5) / k), 6) as sum_share from (select h"
    ", row_number() over (order by h) as r, count(*) over () as k from cd)"
))(
    lambda v: plots.qq(_hets(v), lambda s: s).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("sum_x"), F.round(F.sum("share"), 6).alias("sum_share")
    )
)


def _hets(v: Variations) -> DataFrame:
    from ..functions import genotype as g

    return v.df.select("row_idx", g.n_het(F.col("calls")).cast("double").alias("x"))
