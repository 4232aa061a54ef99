"""Distances between samples and between populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from .populations import members
from .table import Variations


def _pair_rows(v: Variations, one: list[int] | None = None, two: list[int] | None = None) -> DataFrame:
    """row_idx-free rows (i, j, x, y) of diploid genotypes called in both samples.

    The pairs are made inside each variant's row: nothing shuffles before the sums by pair, which
    tasks combine first.
    """
    if v.ploidy != 2:
        raise ValueError("only for diploids")
    calls = F.transform("calls", lambda c, i: F.struct(i.alias("i"), c["gt"].alias("gt")))
    known = F.filter(calls, lambda c: ~g.is_missing(c["gt"]))
    left = known if one is None else F.filter(known, lambda c: c["i"].isin(one))
    right = known if two is None else F.filter(known, lambda c: c["i"].isin(two))
    rows = v.df.select(left.alias("l"), right.alias("r")).select(F.explode("l").alias("l"), "r")
    r = F.filter("r", lambda c: c["i"] > F.col("l.i")) if one is None else F.col("r")
    rows = rows.select("l", F.explode(r).alias("r"))
    return rows.select(F.col("l.i").alias("i"), F.col("r.i").alias("j"), F.col("l.gt").alias("x"), F.col("r.gt").alias("y"))


def kosman_twice(x: Column, y: Column) -> Column:
    """Twice the distance of two genotypes: 0, 1 or 2."""
    shared = sum((F.array_contains(b, a[k]).cast("int") for a, b in ((x, y), (y, x)) for k in (0, 1)), F.lit(0))
    return F.when(shared == 0, 2).when(shared == 4, 0).otherwise(1)


def _masked(stat: Column, n: Column, least: int | None) -> Column:
    return F.when(n >= least, stat) if least else stat


def calc_kosman(v: Variations, min_num_snps: int | None = None, one: list[int] | None = None, two: list[int] | None = None) -> DataFrame:
    sums = _pair_rows(v, one, two).groupBy("i", "j").agg(F.sum(kosman_twice(F.col("x"), F.col("y"))).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select("i", "j", _masked(F.col("s") / (2 * F.col("n")), F.col("n"), min_num_snps).alias("dist"), "n")


def calc_matching(v: Variations, min_num_snps: int | None = None, as_distance: bool = False) -> DataFrame:
    """The share of variants at which two samples have the same unordered genotype; ``as_distance``: 1 minus that."""
    same = F.array_sort("x") == F.array_sort("y")
    sums = _pair_rows(v).groupBy("i", "j").agg(F.count_if(same).alias("s"), F.count(F.lit(1)).alias("n"))
    share = F.col("s") / F.col("n")
    return sums.select("i", "j", _masked(1 - share if as_distance else share, F.col("n"), min_num_snps).alias("dist"), "n")


DISTANCES = {"kosman": calc_kosman, "matching": calc_matching}


def calc_pairwise_distance(v: Variations, method: str = "kosman", min_num_snps: int | None = None) -> DataFrame:
    """i, j (i < j, sample places), dist, n."""
    return DISTANCES[method](v, min_num_snps)


def calc_pairwise_distances_between_pops(v: Variations, pop1_samples: list[str], pop2_samples: list[str], method: str = "kosman", min_num_snps: int | None = None) -> DataFrame:
    if method != "kosman":
        raise NotImplementedError(method)
    return calc_kosman(v, min_num_snps, v.indexes(pop1_samples), v.indexes(pop2_samples))


# --- populations

def _pop_frequencies(v: Variations, populations: dict | None, least: int, by_depth: bool = False) -> DataFrame:
    """row_idx, pop, allele, p, ok: by variant, population and allele; variants with too few genotypes have ok = false."""
    rows = []
    for p, idx in members(v, populations).items():
        calls = g.pick(F.col("calls"), idx)
        if by_depth:
            sums = g.depth_sums(calls)
            counts = F.transform(sums, lambda x, i: F.struct(i.alias("allele"), x.alias("n")))
        else:
            counts = g.allele_counts(calls)
        whole = g.total(counts)
        freqs = _shares(counts, whole)
        ok = (whole > 0) if by_depth or not least else (whole > 0) & (g.n_called(calls) >= least)
        rows.append(F.struct(F.lit(p).alias("pop"), ok.alias("ok"), freqs.alias("freqs")))
    return v.df.select("row_idx", F.explode(F.array(*rows)).alias("s")).select("row_idx", "s.pop", "s.ok", "s.freqs")


def _shares(counts: Column, whole: Column) -> Column:
    return F.transform(counts, lambda c: F.struct(c["allele"].alias("allele"), g.ratio(c["n"], whole).alias("p")))


def _pop_pairs(freqs: DataFrame) -> DataFrame:
    """row_idx, pop1, pop2 (pop1 < pop2) and both sides' columns, of variants that are usable in both.

    Populations are few and of one variant: they meet in its row, not by a join.
    """
    fields = [c for c in freqs.columns if c not in ("row_idx", "ok")]
    rows = freqs.where("ok").groupBy("row_idx").agg(F.collect_list(F.struct(*fields)).alias("pops"))
    rows = rows.select("row_idx", "pops", F.explode("pops").alias("a"))
    rows = rows.select("row_idx", "a", F.explode(F.filter("pops", lambda b: b["pop"] > F.col("a.pop"))).alias("b"))
    return rows.select("row_idx", F.col("a.pop").alias("pop1"), F.col("b.pop").alias("pop2"), "a", "b")


def _dot(x: Column, y: Column) -> Column:
    """Sum of products of the frequencies of the same alleles."""
    return F.aggregate(x, F.lit(0.0), lambda acc, f: acc + f["p"] * F.coalesce(F.aggregate(F.filter(y, lambda h: h["allele"] == f["allele"]), F.lit(0.0), lambda a, h: a + h["p"]), F.lit(0.0)))


def _nei(pairs: DataFrame) -> DataFrame:
    sums = pairs.groupBy("pop1", "pop2").agg(F.sum(_dot(F.col("a.freqs"), F.col("b.freqs"))).alias("xy"), F.sum(_dot(F.col("a.freqs"), F.col("a.freqs"))).alias("xx"), F.sum(_dot(F.col("b.freqs"), F.col("b.freqs"))).alias("yy"))
    identity = F.col("xy") / F.sqrt(F.when(F.col("xx") * F.col("yy") > 0, F.col("xx") * F.col("yy")))
    return sums.select("pop1", "pop2", F.when(identity > 0, -F.log(F.when(identity > 0, identity))).when(identity == 0, float("inf")).alias("dist"))


def calc_nei(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """pop1, pop2, dist."""
    return _nei(_pop_pairs(_pop_frequencies(v, populations, min_num_genotypes)))


def calc_nei_by_depth(v: Variations, populations: dict | None = None, min_num_genotypes: int | None = None) -> DataFrame:
    """From the reads of alleles in place of genotypes."""
    return _nei(_pop_pairs(_pop_frequencies(v, populations, 0, by_depth=True)))


def calc_unbiased_nei(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    """With sums of squares corrected by the number of samples of each population; not below 0."""
    sizes = {p: len(i) for p, i in members(v, populations).items()}
    n = F.create_map(*[F.lit(x) for p, s in sizes.items() for x in (p, s)])
    pairs = _pop_pairs(_pop_frequencies(v, populations, min_num_genotypes))

    def own(side: str, pop: str):
        m = 2 * n[F.col(pop)]
        return (m * _dot(F.col(f"{side}.freqs"), F.col(f"{side}.freqs")) - 1) / (m - 1)

    sums = pairs.groupBy("pop1", "pop2").agg(F.sum(_dot(F.col("a.freqs"), F.col("b.freqs"))).alias("xy"), F.sum(own("a", "pop1")).alias("xx"), F.sum(own("b", "pop2")).alias("yy"))
    identity = F.col("xy") / F.sqrt(F.when(F.col("xx") * F.col("yy") > 0, F.col("xx") * F.col("yy")))
    return sums.select("pop1", "pop2", F.when(identity > 0, F.greatest(F.lit(0.0), -F.log(F.when(identity > 0, identity)))).when(identity == 0, float("inf")).alias("dist"))


def calc_dest(v: Variations, populations: dict | None = None, min_num_genotypes: int = g.MIN_GENOTYPES, min_call_dp_for_het: int = 0) -> DataFrame:
    """Jost's D with the corrections by the harmonic mean of called genotypes, averaged over variants."""
    rows = []
    k = float(v.ploidy)
    for p, idx in members(v, populations).items():
        calls = g.pick(F.col("calls"), idx)
        called = g.n_called(calls)
        freqs = g.frequencies(calls, 0)
        rows.append(F.struct(F.lit(p).alias("pop"), ((called >= min_num_genotypes) & (g.total(g.allele_counts(calls)) > 0)).alias("ok"), freqs.alias("freqs"), called.alias("called"), g.observed_het(calls, 0, min_call_dp_for_het).alias("ho")))
    stats = v.df.select("row_idx", F.explode(F.array(*rows)).alias("s")).select("row_idx", "s.*")
    stats = stats.select("row_idx", "pop", "ok", F.transform("freqs", lambda f: F.struct(f["allele"].alias("allele"), f["freq"].alias("p"))).alias("freqs"), "called", "ho")
    pairs = _pop_pairs(stats)
    powers = lambda f: F.aggregate(f, F.lit(0.0), lambda acc, x: acc + F.pow(x["p"], F.lit(k)))
    p = lambda f, a: F.aggregate(F.filter(f, lambda x: x["allele"] == a), F.lit(0.0), lambda acc, x: acc + x["p"])
    both = F.array_union(F.transform("a.freqs", lambda x: x["allele"]), F.transform("b.freqs", lambda x: x["allele"]))
    hs = ((1 - powers(F.col("a.freqs"))) + (1 - powers(F.col("b.freqs")))) / 2
    ht = 1 - F.aggregate(both, F.lit(0.0), lambda acc, a: acc + F.pow((p(F.col("a.freqs"), a) + p(F.col("b.freqs"), a)) / 2, F.lit(k)))
    ho = F.when(F.col("a.ho").isNull(), F.col("b.ho")).when(F.col("b.ho").isNull(), F.col("a.ho")).otherwise((F.col("a.ho") + F.col("b.ho")) / 2)
    na, nb = F.col("a.called"), F.col("b.called")
    n = 2 / (1 / F.when(na > 0, na) + 1 / F.when(nb > 0, nb))
    rows = pairs.select("pop1", "pop2", hs.alias("hs"), ht.alias("ht"), ho.alias("ho"), n.alias("n"))
    hs2 = F.col("n") / F.when(F.col("n") != 1, F.col("n") - 1) * (F.col("hs") - F.col("ho") / (2 * F.col("n")))
    rows = rows.withColumn("hs2", hs2).withColumn("ht2", F.col("ht") + F.col("hs2") / (2 * F.col("n")) - F.col("ho") / (4 * F.col("n")))
    means = rows.groupBy("pop1", "pop2").agg(F.avg("hs2").alias("hs"), F.avg("ht2").alias("ht"))
    return means.select("pop1", "pop2", (2 * (F.col("ht") - F.col("hs")) / F.when(F.col("hs") != 1, 1 - F.col("hs"))).alias("dist"))


def calc_gst_per_loci(v: Variations, populations: dict | None = None) -> DataFrame:
    """row_idx, gst from the reads of alleles; 0 where it isn't defined."""
    pops = members(v, populations)
    def shares(sums: Column) -> Column:
        whole = F.aggregate(sums, F.lit(0).cast("long"), lambda a, y: a + y)
        return F.transform(sums, lambda x: g.ratio(x, whole))

    freqs = [shares(g.depth_sums(g.pick(F.col("calls"), idx))) for idx in pops.values()]
    square = lambda f: F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x * x)
    hs = sum((1 - square(f) for f in freqs), F.lit(0.0)) / len(freqs)
    summed = freqs[0]
    for f in freqs[1:]:
        summed = F.zip_with(summed, f, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    ht = 1 - square(F.transform(summed, lambda x: x / len(freqs)))
    return v.df.select("row_idx", F.coalesce((ht - hs) / F.when(ht != 0, ht), F.lit(0.0)).alias("gst"))


POP_DISTANCES = {"nei": calc_nei, "nei_unbiased": calc_unbiased_nei, "dest": calc_dest, "nei_depth": calc_nei_by_depth}


def calc_pop_distance(v: Variations, populations: dict | None = None, method: str = "nei", min_num_genotypes: int = g.MIN_GENOTYPES) -> DataFrame:
    return POP_DISTANCES[method](v, populations, min_num_genotypes)


# --- matrices of distances

def hmean(rows: DataFrame, column: str) -> DataFrame:
    """One row: harmonic mean; null if any value is 0 or null."""
    x = F.col(column)
    return rows.agg(F.when(F.count_if(x.isNull() | (x == 0)) == 0, F.count(F.lit(1)) / F.sum(1 / F.when(x != 0, x))).alias("hmean"))


def filter_dist_matrix(dists: DataFrame, keep: list) -> DataFrame:
    return dists.where(F.col("i").isin(keep) & F.col("j").isin(keep))


def select_samples(dists: DataFrame, samples: list[int]) -> DataFrame:
    """The distances of some samples in the order asked for: i < j are places in ``samples``."""
    place = F.create_map(*[F.lit(x) for new, old in enumerate(samples) for x in (old, new)])
    rows = filter_dist_matrix(dists, samples).withColumns({"i": place[F.col("i")], "j": place[F.col("j")]})
    return rows.withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})


def square(dists: DataFrame) -> DataFrame:
    """Both directions and the diagonal: i, j, dist."""
    pairs = dists.select("i", "j", "dist")
    names = pairs.select("i").union(pairs.select("j")).distinct()
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")).unionByName(names.select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist")))


def triangular_dists_to_square(dists: DataFrame, names: list[str]) -> DataFrame:
    """A labelled square table: name, and a column per name."""
    label = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (i, n)])
    return square(dists).select(label[F.col("i")].alias("name"), label[F.col("j")].alias("other"), "dist").groupBy("name").pivot("other", names).agg(F.first("dist"))


def locate_missing(dists: DataFrame) -> DataFrame:
    """i, any_missing."""
    return square(dists).groupBy("i").agg(F.bool_or(F.col("dist").isNull() | F.isnan("dist")).alias("any_missing"))
