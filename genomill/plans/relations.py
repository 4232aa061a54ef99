"""Queries on order, merging, linkage and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, distances, linkage, merge, ordering, populations, variant_stats
from ..operators.table import Variations
from .registry import KOS, MAJOR, ORACLES, R, _rounded, _second, query


def _row(v: Variations, **values) -> DataFrame:
    """One row of whole numbers."""
    return v.df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{k} long" for k in values))


# --- positions

PLACED = ", o as (select chrom, pos, row_number() over (order by chrom, pos, vid) - 1 as place from v)"
query(
    "index_pos",
    PLACED + (
        " select min(place) filter (chrom = 'chr2' and pos >= 1000) as first, min(place) filter (chrom = 'chr3' and pos >= 0) as start"
        ", max(place) filter (chrom = 'chr3') + 1 as beyond from o"
    ),
)(lambda v: (lambda i: _row(v, first=i.index_pos("chr2", 1000), start=i.index_pos("chr3", 0), beyond=i.index_pos("chr3", 1 << 30)))(ordering.PosIndex(ordering.sort_variations(v))))
query("covered_length", " select cast(sum(b - a) as bigint) as n from (select max(pos) as b, min(pos) as a from v group by chrom)")(
    lambda v: _row(v, n=ordering.PosIndex(v).covered_length())
)
query("bisect", (
    " select count_if(chrom < 'chr3' or (chrom = 'chr3' and pos < 1641)) as l"
    ", count_if(chrom < 'chr3' or (chrom = 'chr3' and pos <= 1641)) as r from v"
))(
    lambda v: _row(v, l=ordering.var_bisect_left(v, "chr3", 1641), r=ordering.var_bisect_right(v, "chr3", 1641))
)
query("find_le_ge", PLACED + (
    " select max(place) filter (chrom < 'chr4' or (chrom = 'chr4' and pos <= 999)) as le"
    ", min(place) filter (chrom > 'chr4' or (chrom = 'chr4' and pos >= 999)) as ge from o"
))(
    lambda v: (lambda s: _row(v, le=ordering.find_le(s, "chr4", 999), ge=ordering.find_ge(s, "chr4", 999)))(ordering.sort_variations(v))
)
query("index", " select max(v.vid) as place from v join (select chrom, pos from v where vid = 50) using (chrom, pos)")(lambda v: _row(v, place=ordering.index(v, "chr1", 1014)))
query("find_first_last", (
    " select min(vid) filter (qual > 950) as first, max(vid) filter (qual > 950) as last"
    ", min(vid) filter (qual > 900 and ref = 'G' and vid >= 100) as later from v"
))(
    lambda v: _row(
        v,
        first=ordering.find_first(v, F.col("qual") > 950),
        last=ordering.find_last(v, F.col("qual") > 950),
        later=ordering.find_first_in([v, v], [(F.col("qual") > 900) & (F.col("row_idx") >= 100), F.col("ref") == "G"]),
    )
)
query("sample_variations", " select vid // 100 as chunk, cast(round_even(count(*) * 0.3, 0) as bigint) as n from v group by 1")(
    lambda v: ordering.sample_variations(v.having(v.df), 0.3, 100).df.groupBy(F.floor(F.col("row_idx") / 100).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
)

# --- merging: alleles, genotypes and quality of all rows of both sides

SIDES = (
    ", one as (select vid, chrom, pos, ref, [ref, alt1, alt2] as al, qual from v)"
    ", two as (select vid, chrom, pos + vid % 2 as pos, ref, [ref, alt1, alt2] as al, qual from v where vid % 3 <> 0)"
    ", j as (select coalesce(x.chrom, y.chrom) as chrom, coalesce(x.pos, y.pos) as pos, x.vid as v1, y.vid as v2, coalesce(x.al"
    ", y.al) as al, case when x.vid is null then y.qual when y.vid is null then x.qual else least(x.qual, y.qual) end as qual"
    " from one x full join two y on x.chrom = y.chrom and x.pos = y.pos)"
)


def _merged(v: Variations) -> DataFrame:
    return merge.merge(v, _second(v), check_ref_matches=False, ignore_complex_overlaps=True).df


query("merge_variants", SIDES + " select chrom, cast(pos as int) as pos, al[1] as ref, array_to_string(al[2:], ',') as alt, qual from j")(
    lambda v: _merged(v).select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "qual")
)
query(
    "merge_genotypes",
    SIDES + ", k as (select j.chrom, j.pos, side, sid, case when side = 0 then v1 else v2 end as vid from j, (select unnest([0, 1]) as side), s)"
    " select k.chrom, cast(k.pos as int) as pos, cast(k.sid + 25 * side as int) as sample_idx, g.a0, g.a1 from k left"
    " join g on g.vid = k.vid and g.sid = k.sid",
)(lambda v: _merged(v).select("chrom", "pos", F.posexplode("calls").alias("sample_idx", "c")).select("chrom", "pos", "sample_idx", F.col("c.gt")[0].alias("a0"), F.col("c.gt")[1].alias("a1")))
LONGER = "case when vid % 4 = 0 then ref || 'AC' else ref end"
query(
    "merge_spliced",
    (
        " select chrom, cast(pos as int) as pos, ref || 'AC' as ref"
        ", alt1 || ',' || alt2 || ',' || alt1 || 'AC' || ',' || alt2 || 'AC' as alt, qual from v where vid % 4 = 0"
    ),
)(
    lambda v: merge.merge(
        v.having(v.df.where("row_idx % 4 = 0").withColumn("ref", F.concat("ref", F.lit("AC")))),
        v.having(v.df.where("row_idx % 4 = 0"), samples=[f"{s}-2" for s in v.samples]),
    ).df.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "qual")
)

# --- linkage

query(
    "pairwise_ld",
    MAJOR + ", p as (select x.vid as a, y.vid as b, count(*) as n, sum(x.dose) as sx, sum(y.dose) as sy, sum(x.dose * x.dose) as sxx"
    ", sum(y.dose * y.dose) as syy, sum(x.dose * y.dose) as sxy"
    " from ds x join ds y on x.sid = y.sid and x.vid < y.vid"
    " where x.vid < 40 and y.vid < 40 and x.dose is not null and y.dose is not null group by 1, 2)"
    f" select a, b, round(pow({R.format(least=0)}, 2), 8) as r2 from p",
)(lambda v: _rounded(linkage.pairwise_ld(v.chunk(0, 40)), "r2"))
AGREE = (
    MAJOR + ", d as (select chrom, vid, row_number() over (partition by chrom order by vid) as i, missing, doses from (select v.chrom, v.vid"
    ", count_if(dose is null) / 25 as missing, list(coalesce(dose, -1) order by sid) as doses from v join ds using (vid)"
    " where v.vid < 120 group by 1, 2))"
    ", pr as (select a.chrom, a.i as i, b.i as j, count_if(x >= 0 and y >= 0) as n, count_if(x >= 0 and y >= 0 and x = y) as same"
    ", count_if(x >= 0 and y >= 0 and x = 2 - y) as turned"
    " from (select chrom, i, unnest(doses) as x, generate_subscripts(doses, 1) as k from d) a join (select chrom, i, unnest(doses) as y"
    ", generate_subscripts(doses, 1) as k from d) b on a.chrom = b.chrom and a.k = b.k and b.i > a.i group by 1, 2, 3)"
    ", st2 as (select chrom, i, j, n >= 10 as known, n >= 10 and greatest(same, turned) / n > 0.7 as agrees from pr)"
    ", brk as (select chrom, i, min(j) filter (known and not agrees) as stop from st2 group by 1, 2)"
    ", ends as (select d.chrom, d.i, coalesce(max(j) filter (agrees and j < coalesce(stop, 1 << 30)), d.i) as last from d left"
    " join brk using (chrom, i) left join st2 using (chrom, i) group by 1, 2)"
)
query(
    "blocks_scan",
    AGREE + ", firsts as (select chrom, i, coalesce((select min(e.i) from d e where e.chrom = d.chrom and e.i >= d.i and e.missing < 0.9)"
    ", null) as start from d)"
    ", walk as (select chrom, start as i from firsts where i = 1 union all select w.chrom, f.start from walk w"
    " join ends e on e.chrom = w.chrom and e.i = w.i join firsts f on f.chrom = w.chrom and f.i = e.last + 1 where f.start is not null)"
    " select w.chrom, v1.pos as start, v2.pos + 1 as stop from walk w join ends e using (chrom, i)"
    " join d d1 on d1.chrom = w.chrom and d1.i = w.i join v v1 on v1.vid = d1.vid join d d2 on d2.chrom = w.chrom and d2.i = e.last"
    " join v v2 on v2.vid = d2.vid",
)(lambda v: blocks.generate_blocks(v.chunk(0, 120), difference_rate_allowed=0.3).select("chrom", "start", "stop"))
ORACLES["blocks_scan"] = ORACLES["blocks_scan"].replace("with v as", "with recursive v as", 1)
query(
    "group_variations",
    ", x as (select *, vid // 20 as blk from v where vid < 200 and vid in (select vid from m group by vid having count_if(not called or het) = 0))"
    " select chrom, min(pos) as pos, cast(count(*) as int) as sn from x group by chrom, blk",
)(lambda v: blocks.group_variations(v.chunk(0, 200), _twenty(v), remove_snps_with_hets_or_missing=True).select("chrom", "pos", "sn"))


def _twenty(v: Variations) -> DataFrame:
    """Blocks of twenty rows, for each chromosome that they have."""
    start = F.floor(F.col("row_idx") / 20) * 20
    return v.df.where("row_idx < 200").select("chrom", start.alias("start_idx"), (start + 20).alias("stop_idx")).distinct()


# --- distances

query(
    "kosman_between_pops",
    KOS.replace("x.sid < y.sid", "x.pop = 0 and y.pop = 1") + (
        " select cast(i as int) as i, cast(j as int) as j"
        ", sum(case when sh = 0 then 2 when sh = 4 then 0 else 1 end) / (2 * count(*)) as dist, count(*) as n from pr group by 1, 2"
    ),
)(lambda v: distances.calc_pairwise_distances_between_pops(v, v.populations["0"], v.populations["1"]))
DEPTH = (
    ", x as (select vid, pop, dp, cast(dp * (cast(coalesce(a0, 0) > 0 as int) + cast(coalesce(a1, 0) > 0 as int)) // 2 as bigint) as o from g)"
    ", y as (select vid, pop, sum(dp - o) / sum(dp) as r, sum(o) / sum(dp) as o from x group by 1, 2 having sum(dp) > 0)"
)
query(
    "nei_by_depth",
    DEPTH + ", z as (select a.pop as pop1, b.pop as pop2, sum(a.r * b.r + a.o * b.o) as xy, sum(a.r * a.r + a.o * a.o) as xx"
    ", sum(b.r * b.r + b.o * b.o) as yy from y a join y b on a.vid = b.vid and a.pop < b.pop group by 1, 2)"
    " select cast(pop1 as varchar) as pop1, cast(pop2 as varchar) as pop2, round(-ln(xy / sqrt(xx * yy)), 8) as dist from z",
)(lambda v: _rounded(distances.calc_nei_by_depth(v), "dist"))
query("hmean", " select round(count(*) / sum(1 / qual), 6) as hmean from v")(lambda v: _rounded(distances.hmean(v.df, "qual"), "hmean", digits=6))
DISTS = KOS + (
    ", di as (select cast(i as int) as i, cast(j as int) as j"
    ", sum(case when sh = 0 then 2 when sh = 4 then 0 else 1 end) / (2 * count(*)) as dist from pr group by 1, 2)"
)
query("filter_dist_matrix", DISTS + " select i, j, dist from di where i in (1, 4, 9) and j in (1, 4, 9)")(
    lambda v: distances.filter_dist_matrix(distances.calc_kosman(v), [9, 1, 4]).select("i", "j", "dist")
)
query("select_samples_of_distances", DISTS + (
    ", o as (select unnest([9, 1, 4]) as old, unnest([0, 1, 2]) as new) select least(a.new, b.new) as i, greatest(a.new, b.new) as j"
    ", dist from di join o a on a.old = i join o b on b.old = j"
))(
    lambda v: distances.select_samples(distances.calc_kosman(v), [9, 1, 4]).select("i", "j", "dist")
)
query("square_distances", DISTS + (
    ", q as (select i, j, dist from di union all select j, i, dist from di union all select cast(sid as int), cast(sid as int), 0.0"
    " from s) select a.sample as name, max(dist) filter (j = 0) as \"NATION_0\", max(dist) filter (j = 2) as \"NATION_2\" from q"
    " join s a on a.sid = i group by 1"
))(
    lambda v: distances.triangular_dists_to_square(distances.calc_kosman(v), v.samples).select("name", "NATION_0", "NATION_2")
)
query("missing_distances", DISTS + " select cast(sid as int) as i, coalesce(bool_or(dist > 0.6), false) as any_missing from s left join di on sid in (i, j) group by 1")(
    lambda v: distances.locate_missing(distances.calc_kosman(v).withColumn("dist", F.when(F.col("dist") <= 0.6, F.col("dist"))))
)
TAJIMA = (
    ", x as (select vid, {k} as k, a0 from g where a0 is not null), al as (select k, vid, a0, count(*) as c from x group by 1, 2, 3)"
    ", h as (select k, vid, sum(c) as n, count(*) as alleles from al group by 1, 2)"
    ", f as (select al.k, al.vid, min(h.n) as n, min(alleles) as alleles, 1 - sum(pow(c / h.n, 2)) as h from al"
    " join h on h.k = al.k and h.vid = al.vid group by 1, 2)"
    ", w as (select f.*, (select coalesce(sum(1.0 / i), 0) from range(1, 60) r(i)"
    " where i < f.n) as a1, (select coalesce(sum(1.0 / (i * i)), 0) from range(1, 60) r(i) where i < f.n) as a2 from f)"
    ", z as (select k, count_if(alleles > 1) as s, avg(a1) as a1, avg(a2) as a2, avg(n) as n"
    ", sum(case when n > 1 then n / (n - 1) * h end) as pi from w group by 1)"
    ", e as (select *, (n + 1) / (3 * (n - 1)) as b1, 2 * (n * n + n + 3) / (9 * n * (n - 1)) as b2 from z)"
    ", e2 as (select *, (b1 - 1 / a1) / a1 as e1, (b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) as e2 from e)"
)
query("tajima_d", TAJIMA.format(k="0") + (
    " select s as seg_sites, round(s / a1, 6) as theta, round(pi, 6) as pi"
    ", round((pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 6) as d from e2"
))(
    lambda v: _rounded(variant_stats.tajima(v, 0, haplotype=0).select("seg_sites", "theta", "pi", "d"), "theta", "pi", "d", digits=6)
)
query("tajima_by_pop", TAJIMA.format(k="pop") + (
    " select cast(k as varchar) as pop, s as seg_sites, round(s / a1, 6) as theta, round(pi, 6) as pi"
    ", round((pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 6) as d from e2"
))(
    lambda v: _rounded(populations.calc_tajima_d_and_pi_for_pops(v, min_num_genotypes=0, haplotype=0).select("pop", "seg_sites", "theta", "pi", "d"), "theta", "pi", "d", digits=6)
)
