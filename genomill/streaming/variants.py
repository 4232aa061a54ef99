"""Tables that grow: filters of single variants run on a stream as they do on a table, for they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import BaseFilter
from ..operators.table import Variations


def read_store(spark: SparkSession, path: str, like: Variations) -> Variations:
    """A stream of the rows that arrive in a store's folder."""
    return like.having(spark.readStream.schema(like.df.schema).parquet(f"{path}/variations"))


def filtered(v: Variations, filters: list[BaseFilter]) -> DataFrame:
    """The rows that all filters keep."""
    for f in filters:
        v = f(v).kept
    return v.df


def counts_by_chrom(v: Variations) -> DataFrame:
    """A running count by chromosome, for output mode complete."""
    return v.df.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
