"""Sorting, positions, and exact sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .table import CHUNK, Variations


#: Positions of a chromosome that are sorted by one task.
BLOCK = 1_000_000


def _blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("_block", F.floor(F.coalesce(F.col("pos"), F.lit(-1)) / BLOCK))


def sort_variations(v: Variations) -> Variations:
    """By chromosome (byte order), position and former place; row_idx is the new place.

    Blocks of positions are ranked each by itself, after as many rows as the blocks before it have: a row for each
    block of the genome is all that is broadcast.
    """
    rows = _blocks(v.df)
    sizes = rows.groupBy("chrom", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("chrom", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(F.col("chrom").alias("_chrom"), F.col("_block").alias("_of"), before.alias("_before")))
    ranked = F.row_number().over(Window.partitionBy("chrom", "_block").orderBy("pos", "row_idx"))
    df = rows.join(offsets, F.col("chrom").eqNullSafe(F.col("_chrom")) & (F.col("_block") == F.col("_of")))
    return v.having(df.withColumn("row_idx", (ranked - 1 + F.col("_before")).cast("long")).select(*v.df.columns))


def _upto(chrom: str, pos: int, inclusive: bool) -> Column:
    """Rows before (chrom, pos), or at it too; simple comparisons, which Parquet's statistics can answer."""
    p = F.col("pos") <= pos if inclusive else F.col("pos") < pos
    return (F.col("chrom") < chrom) | ((F.col("chrom") == chrom) & p)


def _from(chrom: str, pos: int) -> Column:
    return (F.col("chrom") > chrom) | ((F.col("chrom") == chrom) & (F.col("pos") >= pos))


def var_bisect_left(v: Variations, chrom: str, pos: int) -> int:
    """How many rows are before (chrom, pos)."""
    return v.df.where(_upto(chrom, pos, False)).count()


def var_bisect_right(v: Variations, chrom: str, pos: int) -> int:
    return v.df.where(_upto(chrom, pos, True)).count()


def find_le(v: Variations, chrom: str, pos: int) -> int:
    """The last row at or before a place."""
    got = v.df.where(_upto(chrom, pos, True)).agg(F.max("row_idx")).first()[0]
    if got is None:
        raise ValueError("no variation there or before")
    return got


def find_ge(v: Variations, chrom: str, pos: int) -> int:
    got = v.df.where(_from(chrom, pos)).agg(F.min("row_idx")).first()[0]
    if got is None:
        raise ValueError("no variation there or after")
    return got


def index(v: Variations, chrom: str, pos: int) -> int:
    got = v.df.where((F.col("chrom") == chrom) & (F.col("pos") == pos)).agg(F.max("row_idx")).first()[0]
    if got is None:
        raise IndexError(f"no variation at {chrom} {pos}")
    return got


class PosIndex:
    """Places of a table that is sorted by chromosome and position; ranges are pruned by Parquet's own statistics."""

    def __init__(self, v: Variations):
        self.v = v

    def chroms(self) -> list[str]:
        return self.v.chroms()

    def ranges(self) -> DataFrame:
        """chrom, first_idx, last_idx, first_pos, last_pos."""
        return self.v.df.groupBy("chrom").agg(F.min("row_idx").alias("first_idx"), F.max("row_idx").alias("last_idx"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))

    def _of(self, chrom: str):
        row = self.ranges().where(F.col("chrom") == chrom).first()
        if row is None:
            raise IndexError(chrom)
        return row

    def get_chrom_range_index(self, chrom: str) -> tuple[int, int]:
        row = self._of(chrom)
        return row.first_idx, row.last_idx

    def get_chrom_range_pos(self, chrom: str) -> tuple[int, int]:
        row = self._of(chrom)
        return row.first_pos, row.last_pos

    def covered_length(self) -> int:
        return self.ranges().agg(F.sum(F.col("last_pos") - F.col("first_pos"))).first()[0] or 0

    def index_pos(self, chrom: str, pos: int) -> int:
        """The first row of the chromosome at or after a position, or the place after its last."""
        rows = self.v.df.where(F.col("chrom") == chrom)
        first, last = rows.agg(F.min(F.when(F.col("pos") >= pos, F.col("row_idx"))), F.max("row_idx")).first()
        if last is None:
            raise IndexError(chrom)
        return last + 1 if first is None else first


def find_first(v: Variations, condition: Column, start: int = 0) -> int | None:
    got = v.df.where(condition & (F.col("row_idx") >= start)).agg(F.min("row_idx")).first()[0]
    if got is None:
        raise ValueError("no row fulfils the condition")
    return got


def find_first_in(tables: list[Variations], conditions: list[Column]) -> int | None:
    """The first row that fulfils the conditions of all tables, row by row; the tables have the same rows."""
    rows = tables[0].df.where(conditions[0]).select("row_idx")
    for v, condition in zip(tables[1:], conditions[1:], strict=True):
        rows = rows.join(v.df.where(condition).select("row_idx"), "row_idx", "left_semi")
    got = rows.agg(F.min("row_idx")).first()[0]
    if got is None:
        raise ValueError("no row fulfils the conditions")
    return got


def find_last(v: Variations, condition: Column) -> int:
    got = v.df.where(condition).agg(F.max("row_idx")).first()[0]
    if got is None:
        raise ValueError("no row fulfils the condition")
    return got


def sample_variations(v: Variations, sample_rate: float, chunk_size: int = CHUNK, seed: int = 0) -> Variations:
    """round(n * rate) rows of each chunk, in their order."""
    return v.having(v.chunks(chunk_size, sample_rate=sample_rate, seed=seed).drop("chunk").orderBy("row_idx"))
