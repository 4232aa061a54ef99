"""Lines of text in the order of their files, however Spark deals files out: it reads large files first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where a line lies: its file, the block of the file that a task reads at once, and a number that rises within the block.
PLACE = ("_file", "_start", "_id")


def by_file(text: DataFrame) -> list[DataFrame]:
    """The lines of each file, in the order of the files' names; nothing is read here."""
    names = [(f, f.replace(":///", ":/", 1)) for f in sorted(text.inputFiles())]
    return [text.where(F.col("_metadata.file_path").isin(*both)) for both in names]


def placed(text: DataFrame, chosen=lambda rows: rows) -> DataFrame:
    """value and PLACE of the lines that ``chosen`` leaves."""
    rows = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return chosen(rows).withColumn("_id", F.monotonically_increasing_id())


def numbered(rows: DataFrame) -> DataFrame:
    """row_idx in place of PLACE: places within each block after the sizes of the blocks before it.

    No row may be gone since ``placed``, so that numbers are without gaps.
    """
    blocks = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_file", "_start", (before - F.col("_first")).alias("_before"))  # a row per block of a file
    out = rows.join(F.broadcast(blocks), ["_file", "_start"])
    return out.select((F.col("_id") + F.col("_before")).alias("row_idx"), *[c for c in rows.columns if c not in PLACE])
