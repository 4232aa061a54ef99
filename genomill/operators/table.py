"""The variation table: a DataFrame with one row per variant, its samples and their populations.

Columns: row_idx, chrom, pos, id, ref, alt, qual, filters, info, calls; only row_idx, chrom, pos and
calls are needed by all operators. ``calls`` has a struct per sample, in the order of ``samples``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 600


@dataclass
class Variations:
    """A table with what describes it. Operators return new tables; nothing is changed in place."""

    df: DataFrame
    samples: list[str]
    ploidy: int = 2
    populations: dict[str, list[str]] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def __getitem__(self, column: str) -> DataFrame:
        return self.df.select("row_idx", column)

    def __contains__(self, column: str) -> bool:
        return column in self.df.columns

    def having(self, df: DataFrame, **changes) -> Variations:
        return replace(self, df=df, **changes)

    def with_field(self, name: str, column) -> Variations:
        return self.having(self.df.withColumn(name, column))

    def without_field(self, name: str) -> Variations:
        if name not in self.df.columns:
            raise KeyError(name)
        return self.having(self.df.drop(name))

    def num_variations(self) -> int:
        return self.df.count()

    def chroms(self) -> list[str]:
        return [r[0] for r in self.df.select("chrom").distinct().orderBy("chrom").collect()]

    def indexes(self, samples: list[str]) -> list[int]:
        """Places of samples in the calls, in the table's order; unknown or repeated names are refused."""
        if len(set(samples)) != len(samples):
            raise ValueError("repeated samples")
        unknown = set(samples) - set(self.samples)
        if unknown:
            raise ValueError(f"unknown samples: {sorted(unknown)}")
        return [i for i, s in enumerate(self.samples) if s in set(samples)]

    def rename_samples(self, samples: list[str]) -> Variations:
        if len(samples) != len(self.samples):
            raise ValueError("as many names as samples are needed")
        return replace(self, samples=list(samples))

    # projection and slices

    def fields(self, kept: list[str] | None = None, ignored: list[str] | None = None) -> Variations:
        if kept is not None and ignored is not None:
            raise ValueError("kept and ignored fields exclude each other")
        unknown = set(kept or ignored or ()) - set(self.df.columns)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if kept is not None:
            return self.having(self.df.select(*kept))
        return self.having(self.df.drop(*(ignored or ())))

    def copy(self, kept: list[str] | None = None, ignored: list[str] | None = None) -> Variations:
        """A table of its own with some of the fields: other names, metadata and populations may be put into it."""
        out = self.fields(kept, ignored)
        return replace(out, samples=list(self.samples), populations={p: list(x) for p, x in self.populations.items()}, metadata=dict(self.metadata))

    def chunk(self, start: int = 0, stop: int | None = None) -> Variations:
        """Rows by row_idx, the end not included; a scan with the bound pushed down."""
        rows = self.df.where(F.col("row_idx") >= start)
        return self.having(rows if stop is None else rows.where(F.col("row_idx") < stop))

    def chunks(self, size: int = CHUNK, start: int = 0, stop: int | None = None, sample_rate: float = 1.0, seed: int = 0) -> DataFrame:
        """The rows with the number of their chunk; a rate below 1 keeps round(n * rate) rows of each chunk."""
        rows = self.chunk(start, stop).df.withColumn("chunk", F.floor((F.col("row_idx") - start) / size))
        if sample_rate >= 1:
            return rows
        chosen = F.row_number().over(Window.partitionBy("chunk").orderBy(F.xxhash64("row_idx", F.lit(seed)), "row_idx"))
        n = F.count(F.lit(1)).over(Window.partitionBy("chunk"))
        return rows.withColumn("_place", chosen).withColumn("_n", n).where(F.col("_place") <= F.round(F.col("_n") * sample_rate)).drop("_place", "_n")

    def region(self, chrom: str, start: int | None = None, end: int | None = None) -> Variations:
        """Rows of a chromosome in [start, end)."""
        rows = self.df.where(F.col("chrom") == chrom)
        if start is not None:
            rows = rows.where(F.col("pos") >= start)
        if end is not None:
            rows = rows.where(F.col("pos") < end)
        return self.having(rows)

    def by_chrom(self, chroms: list[str] | None = None):
        """(chrom, table) in order; chromosomes that aren't there are skipped."""
        there = self.chroms()
        for chrom in there if chroms is None else [c for c in there if c in set(chroms)]:
            yield chrom, self.region(chrom)

    def put(self, other: DataFrame) -> Variations:
        """Rows appended after the last; columns that one side lacks are null there, and new ones are added."""
        shift = self.df.agg(F.coalesce(F.max("row_idx") + 1, F.lit(0))).first()[0]
        return self.having(self.df.unionByName(other.withColumn("row_idx", F.col("row_idx") + shift), allowMissingColumns=True))

    def only_samples(self, indexes: list[int], reverse: bool = False) -> Variations:
        """Calls of some samples by place, in the table's order, or of all others."""
        chosen = [i for i in range(len(self.samples)) if (i in set(indexes)) != reverse]
        calls = F.filter("calls", lambda c, i: i.isin(chosen)) if chosen else F.slice("calls", 1, 0)
        return self.having(self.df.withColumn("calls", calls), samples=[self.samples[i] for i in chosen])

    def only_named(self, samples: list[str], reverse: bool = False) -> Variations:
        return self.only_samples(self.indexes(samples), reverse)

    def with_depth(self, depth: int) -> Variations:
        """All calls with one depth."""
        return self.having(self.df.withColumn("calls", F.transform("calls", lambda c: c.withField("dp", F.lit(depth)))))

    # long views

    def long(self, *columns: str) -> DataFrame:
        """A row per call: row_idx, further columns, sample_idx, and the call's fields."""
        return self.df.select("row_idx", *columns, F.posexplode("calls").alias("sample_idx", "call")).select("row_idx", *columns, "sample_idx", "call.*")

    def sample_table(self) -> DataFrame:
        """sample_idx, sample, pop; a sample of several populations has a row for each."""
        spark = self.df.sparkSession
        pops = {}
        for pop, members in self.populations.items():
            for m in members:
                pops.setdefault(m, []).append(str(pop))
        rows = [(i, s, p) for i, s in enumerate(self.samples) for p in pops.get(s, [None])]
        return spark.createDataFrame(rows, "sample_idx int, sample string, pop string")

    # the store

    def write(self, path: str, parts: int | None = None) -> None:
        """Parquet sorted by chromosome and position, with samples and metadata beside it; an existing store is refused."""
        cut = self.df.repartitionByRange(parts, "chrom", "pos") if parts else self.df.repartitionByRange("chrom", "pos")
        cut.sortWithinPartitions("chrom", "pos", "row_idx").write.mode("error").option("compression", "zstd").parquet(f"{path}/variations")
        meta = json.dumps({"samples": self.samples, "ploidy": self.ploidy, "populations": self.populations, "metadata": self.metadata})
        self.df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("error").text(f"{path}/meta")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Variations:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return Variations(spark.read.parquet(f"{path}/variations"), meta["samples"], meta["ploidy"], meta["populations"], meta["metadata"])
