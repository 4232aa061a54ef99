"""Genotypes derived from the driver's tables: variants from ``part``, samples from ``nation``, populations from regions.

Only whole-number arithmetic, so that Spark and SQL elsewhere get the same alleles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLOIDY = 2


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "cast(p_partkey as bigint) as vid",
        "concat('chr', cast(p_partkey % 5 + 1 as string)) as chrom",
        "cast(p_partkey as bigint) * 20 + (cast(p_partkey as bigint) * 37) % 17 as pos",
        "substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) as ref",
        "substr('ACGT', cast((p_partkey + 1) % 4 as int) + 1, 1) as alt1",
        "substr('ACGT', cast((p_partkey + 2) % 4 as int) + 1, 1) as alt2",
        "p_retailprice as qual",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as bigint) as sid", "n_name as sample", "cast(n_regionkey as bigint) as pop")


def names(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, int]]:
    """(index, name, population) of the samples: a dimension of a few dozen rows."""
    return [tuple(r) for r in samples(spark, sf_dir).orderBy("sid").collect()]


#: Variants of a task, where there are more than tasks at all; cores have a few tasks each.
PER_TASK, TASKS_PER_CORE = 500, 4
CALL = "struct<gt:array<int>,dp:int,gq:int,ro:bigint,ao:array<int>,ad:array<int>>"


def spread(v: DataFrame) -> DataFrame:
    """The variants dealt out over the cores: a file of them is small and may be one group of rows, its calls are many."""
    n = v.select("vid").count()
    cores = v.sparkSession.sparkContext.defaultParallelism
    return v.repartition(max(1, min(TASKS_PER_CORE * cores, n // PER_TASK)), "vid")


def calls_of(sids: list[int]):
    """A function of variants that gives the calls of each; it goes to workers as it is, they need not have this module."""

    def calls(vid: pa.Array) -> pa.Array:
        vids = vid.to_numpy(zero_copy_only=False).astype(np.int64)
        vid, sid = vids[:, None], np.array(sids, np.int64)[None, :]
        shape = len(vids) * len(sids)
        of = lambda a, b, c, m: np.fmod(vid * a + sid * b + vid * sid * c, m)  # noqa: E731 - the sign is the dividend's, as in SQL
        missing = of(6101, 7907, 17, 100) < 8
        share = np.fmod(vid * 37, 50) * 20
        gt = np.empty((len(vids), len(sids), PLOIDY), np.int32)
        for k in range(PLOIDY):
            h = np.fmod(vid * 7919 + sid * 104729 + k * 15485863 + vid * sid * 31, 1000)
            gt[:, :, k] = np.where(h < share, 1, np.where(h >= 985, 2, 0))
        gone = np.repeat(missing.ravel(), PLOIDY)
        dp, gq = (of(*x).ravel().astype(np.int32) for x in ((13, 29, 7, 40), (11, 41, 3, 60)))
        other = dp * ((gt > 0) & ~missing[:, :, None]).sum(axis=2).ravel().astype(np.int32)
        other = (other - np.fmod(other, 2)) // 2
        several = lambda n, flat, mask=None: pa.ListArray.from_arrays(pa.array(np.arange(0, n * shape + 1, n, dtype=np.int32)), pa.array(flat, pa.int32(), mask=mask))
        fields = {
            "gt": several(PLOIDY, gt.ravel(), gone), "dp": pa.array(dp), "gq": pa.array(gq), "ro": pa.array((dp - other).astype(np.int64)),
            "ao": several(1, other), "ad": several(2, np.stack([dp - other, other], axis=1).ravel()),
        }
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vids) + 1, dtype=np.int32) * len(sids), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    return calls


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, chrom, pos, id, ref, alt, qual, calls: one row per variant, without a shuffle of calls.

    Calls are worked out in Arrow batches, once for each variant: as expressions Catalyst would put them into each place of a
    statistic that refers to them. For that they count as not deterministic, though they are.
    """
    sids = [s for s, _, _ in names(spark, sf_dir)]
    calls = F.arrow_udf(calls_of(sids), f"array<{CALL}>").asNondeterministic()
    out = spread(variants(spark, sf_dir)).withColumn("calls", calls("vid"))
    return out.selectExpr("vid as row_idx", "chrom", "cast(pos as int) as pos", "cast(vid as string) as id", "ref", "array(alt1, alt2) as alt", "cast(qual as double) as qual", "calls")


#: The same tables for SQL elsewhere: v, s, calls.
SQL = """
with v as (
  select cast(p_partkey as bigint) as vid, concat('chr', cast(p_partkey % 5 + 1 as varchar)) as chrom,
         cast(p_partkey as bigint) * 20 + (cast(p_partkey as bigint) * 37) % 17 as pos,
         substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) as ref, substr('ACGT', cast((p_partkey + 1) % 4 as int) + 1, 1) as alt1,
         substr('ACGT', cast((p_partkey + 2) % 4 as int) + 1, 1) as alt2, cast(p_retailprice as double) as qual
  from part),
s as (select cast(n_nationkey as bigint) as sid, n_name as sample, cast(n_regionkey as bigint) as pop from nation),
c as (
  select vid, sid, pop, k as hap, (vid * 7919 + sid * 104729 + k * 15485863 + vid * sid * 31) % 1000 as h1,
         (vid * 6101 + sid * 7907 + vid * sid * 17) % 100 as h2, (vid * 37) % 50 as pf,
         (vid * 13 + sid * 29 + vid * sid * 7) % 40 as dp, (vid * 11 + sid * 41 + vid * sid * 3) % 60 as gq
  from v cross join s cross join (select cast(0 as bigint) as k union all select cast(1 as bigint) as k) h),
a as (select vid, sid, pop, hap, dp, gq, case when h2 < 8 then null when h1 < pf * 20 then 1 when h1 >= 985 then 2 else 0 end as allele from c),
g as (
  select vid, sid, pop, min(dp) as dp, min(gq) as gq, max(case when hap = 0 then allele end) as a0, max(case when hap = 1 then allele end) as a1
  from a group by vid, sid, pop),
m as (select *, a0 is not null and a1 is not null as called, a0 <> a1 as het from g),
n as (select vid, allele, count(*) as n from a where allele is not null group by vid, allele)
"""
