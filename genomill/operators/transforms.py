"""Changes of calls and fields, within each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as g
from .table import CHUNK, Variations


def _none(gt: Column) -> Column:
    return F.transform(gt, lambda a: F.lit(None).cast("int"))


def set_missing_below(v: Variations, field: str, least: int, field_too: bool = True) -> Variations:
    """Genotypes (and the field) of calls whose field is below ``least``, or unknown, become missing."""

    def fix(c):
        bad = F.coalesce(c[field] < least, F.lit(True))
        out = c.withField("gt", F.when(bad, _none(c["gt"])).otherwise(c["gt"]))
        return out.withField(field, F.when(~bad, c[field])) if field_too else out

    return v.having(v.df.withColumn("calls", F.transform("calls", fix)))


class LowDPGTsToMissingSetter:
    field = "dp"

    def __init__(self, minimum: int, query_field_to_missing: bool = True):
        self.minimum, self.too = minimum, query_field_to_missing

    def __call__(self, v: Variations) -> Variations:
        return set_missing_below(v, self.field, self.minimum, self.too)


class LowQualGTsToMissingSetter(LowDPGTsToMissingSetter):
    field = "gq"


def fix_duplicated_alleles(v: Variations) -> Variations:
    """Equal REF and ALT strings become one allele, the first; genotypes are renumbered."""
    every = F.concat(F.array("ref"), F.coalesce("alt", F.array().cast("array<string>")))
    df = v.df.withColumn("_all", every).withColumn("_one", F.array_distinct("_all"))
    number = lambda a: F.when(a.isNotNull(), (F.array_position("_one", F.get("_all", a)) - 1).cast("int"))
    calls = F.transform("calls", lambda c: c.withField("gt", F.transform(c["gt"], number)))
    return v.having(df.withColumn("calls", calls).withColumn("alt", F.slice("_one", F.lit(2), F.size("_one"))).drop("_all", "_one"))


def is_variable(v: Variations, samples: list[str] | None = None) -> DataFrame:
    """row_idx, is_variable: 1 with more than one allele, 0 with one, null without any."""
    return v.df.select("row_idx", _variable(v, samples).alias("is_variable"))


def _variable(v: Variations, samples: list[str] | None) -> Column:
    n = F.size(g.allele_counts(g.pick(F.col("calls"), None if samples is None else v.indexes(samples))))
    return F.when(n > 0, (n > 1).cast("int"))


class IsVariableAnnotator:
    """Adds the field of that name, with a description."""

    def __init__(self, annot_id: str, samples: list[str] | None = None):
        self.id, self.samples = annot_id, samples

    def __call__(self, v: Variations) -> Variations:
        about = f"True if the variant has several alleles. Samples: {', '.join(self.samples or ['all'])}"
        return v.having(v.df.withColumn(self.id, _variable(v, self.samples).alias(self.id, metadata={"Description": about, "Type": "Integer", "Number": 1})))


def gts_as_mat012(v: Variations) -> DataFrame:
    """row_idx, dose: alleles that aren't the major one, by sample."""
    return v.df.select("row_idx", g.dosages(F.col("calls")).alias("dose"))


def random_haploid_gts(v: Variations, seed: int = 0) -> DataFrame:
    """row_idx, hap: one allele of each sample, of the same haplotype at all variants."""
    import random

    draw = random.Random(seed)
    chosen = F.array(*[F.lit(draw.randrange(v.ploidy)) for _ in v.samples])
    return v.df.select("row_idx", F.zip_with("calls", chosen, lambda c, h: F.get(c["gt"], h)).alias("hap"))


def set_random_missing(v: Variations, rate: float, seed: int = 0, chunk_size: int = CHUNK) -> Variations:
    """round(n * rate) of the n called genotypes of each chunk become missing, drawn by hashes of the seed."""
    called = v.long().where(~g.is_missing(F.col("gt"))).select("row_idx", "sample_idx", F.floor(F.col("row_idx") / chunk_size).alias("chunk"))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(F.xxhash64("row_idx", "sample_idx", F.lit(seed)), "row_idx", "sample_idx"))
    n = F.count(F.lit(1)).over(Window.partitionBy("chunk"))
    drawn = called.select("row_idx", "sample_idx", place.alias("place"), n.alias("n")).where(F.col("place") <= F.bround(F.col("n") * rate))
    drawn = drawn.groupBy("row_idx").agg(F.collect_set("sample_idx").alias("_drawn"))  # as many as there are samples at most
    hit = lambda i: F.coalesce(F.array_contains("_drawn", i), F.lit(False))
    calls = F.transform("calls", lambda c, i: c.withField("gt", F.when(hit(i), _none(c["gt"])).otherwise(c["gt"])))
    return v.having(v.df.join(drawn, "row_idx", "left").withColumn("calls", calls).select(*v.df.columns))


COMPLEMENT = ("ACGTacgt", "TGCAtgca")


def change_strand(v: Variations, other: DataFrame) -> Variations:
    """Complements the alleles of the rows whose ``flip`` in (row_idx, flip) is true; longer alleles stay."""
    one = lambda a: F.when(F.length(a) == 1, F.translate(a, *COMPLEMENT)).otherwise(a)
    df = v.df.join(other.select("row_idx", "flip"), "row_idx", "left")
    flip = F.coalesce("flip", F.lit(False))
    df = df.withColumn("ref", F.when(flip, one(F.col("ref"))).otherwise(F.col("ref"))).withColumn("alt", F.when(flip, F.transform("alt", one)).otherwise(F.col("alt")))
    return v.having(df.select(*v.df.columns))


def count_compatible_snps(v: Variations, strands: DataFrame, max_snps_check: int | None = None) -> DataFrame:
    """strand, n, checked: how many of the first variants fit each candidate strand, and how many were looked at.

    ``strands`` (row_idx, alleles, like_reference): the alleles that a place has on the reference strand, and for each
    candidate whether it runs like the reference there. If it does, a variant fits when all its alleles are among
    them; if it does not, when all are among their complements.
    """
    rows = v.df.join(strands, "row_idx")
    if max_snps_check is not None:
        rows = rows.orderBy("row_idx").limit(max_snps_check)
    every = F.filter(F.concat(F.array("ref"), F.coalesce("alt", F.array().cast("array<string>"))), lambda a: a != "")
    fits = lambda alleles: F.size(F.array_except(every, alleles)) == 0
    same, turned = fits(F.col("alleles")), fits(F.transform("alleles", lambda a: F.translate(a, *COMPLEMENT)))
    hits = F.transform("like_reference", lambda like: F.when(like, same).otherwise(turned))
    rows = rows.select(F.posexplode(hits).alias("strand", "hit"))
    return rows.groupBy("strand").agg(F.count_if("hit").alias("n"), F.count(F.lit(1)).alias("checked"))
