"""Arrays of a size: what matrices that grow and shrink become as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resized(column: Column, size: int | Column, value=None) -> Column:
    """The first ``size`` members, followed by as many of ``value`` as it takes; null stays null."""
    size = F.lit(size) if isinstance(size, int) else size
    missing = F.greatest(size - F.size(column), F.lit(0))
    return F.when(column.isNotNull(), F.concat(F.slice(column, F.lit(1), size), F.array_repeat(F.lit(value), missing)))


def stacked(tables: list[DataFrame], column: str, value=None) -> DataFrame:
    """The rows of all tables; shorter arrays of a column are filled up to the longest of any table."""
    widest, out = 0, None
    for df in tables:
        widest = max(widest, df.agg(F.max(F.size(column))).first()[0] or 0)
    for df in tables:
        kind = df.schema[column].dataType
        one = df.withColumn(column, resized(F.col(column), widest, value).cast(kind if isinstance(kind, T.ArrayType) else "array<string>"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def packets(df: DataFrame, column: str, size: int, order: str = "row_idx", fill=None, filled: bool = False) -> DataFrame:
    """packet, members: the values of a column by ``size`` consecutive numbers of ``order``; ``filled``: the last one too has ``size`` members."""
    rows = df.groupBy(F.floor(F.col(order) / size).alias("packet")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.col(column).alias("value")))).alias("x"))  # size rows at most
    members = F.transform("x", lambda s: s["value"])
    return rows.select("packet", (resized(members, size, fill) if filled else members).alias("members"))
