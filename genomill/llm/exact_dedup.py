"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one
space. Three stages merge equal texts, and each groups by the digest *and* the whole text, so a
digest that two texts share never joins them:

1. local: Spark's partial aggregation merges the copies within a task,
2. salted: groups of (digest, salt, text), the salt coming from the task, so that even a third of
   all rows being one text reaches many reducers with one row per task,
3. global: the winners of at most ``salts`` salts of a digest meet.

Documents then find their winner by digest; the few digests that several texts share (none, in
practice, for SHA-256) are looked up by digest and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WHITE = r"[\x20\x09-\x0D]+"
#: A group of more rows than this part of all is dealt out over salts on its way back to the rows.
HOT = 1000


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def assign(docs: DataFrame, salts: int = 16, digest_bits: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. ``keep_id`` is the smallest doc_id of the group (null ids give
    way to any other, and a group of only null ids has a null keep_id); of rows that repeat the
    kept doc_id with the same text exactly one has ``kept``. Other columns of ``docs`` are ignored.
    An empty table gives an empty table. ``digest_bits`` shortens the digest that groups meet by,
    to show that the comparison of whole texts decides.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    base = base.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    base = base.withColumn("digest", F.expr(f"substring(sha, 1, {digest_bits // 8})") if digest_bits < 256 else F.col("sha"))

    salted = (
        base.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    winners = (
        salted.repartition(F.col("digest"))
        .groupBy("digest", "norm")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("digest")))
        .select("digest", "keep_id", "group_size", "texts", F.when(F.col("texts") > 1, F.col("norm")).alias("norm"))
    )
    winners = shared.keep(winners, "winners")

    # Rows that repeat one document are counted before the join and dealt out again after it. Groups of more than
    # a thousandth of all rows, a thousand at most, are dealt out over salts; each salt has a copy of their winner.
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    hot = F.broadcast(winners.where(F.col("group_size") * HOT > total).select("digest").distinct().withColumn("hot", F.lit(True)))
    rows = base.groupBy("doc_id", "digest", "sha").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(0).cast("int")).drop("hot")
    copies = F.when(F.col("group_size") * HOT > total, F.lit(salts)).otherwise(1)
    one_text = winners.where("texts = 1").drop("norm").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    found = rows.join(one_text, ["digest", "salt"]).drop("salt")
    shared_digests = winners.where("texts > 1")
    if not shared_digests.isEmpty():
        rows = base.groupBy("doc_id", "digest", "sha", "norm").agg(F.count(F.lit(1)).alias("times"))
        found = found.unionByName(rows.join(shared_digests, ["digest", "norm"]).drop("norm"))
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return found.select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"), copy.alias("copy")).select(
        "doc_id", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that ``assign`` keeps, with all their columns.

    Nulls, ties and repeated rows: as in ``assign``; exactly one row of each group of equal texts stays.
    """
    kept = assign(docs, salts).where("kept").select(F.struct("doc_id").alias("_id"), F.col("text_sha256").alias("_own"))
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id").alias("_id"), F.sha2(normalised(F.col("text")), 256).alias("_own"))
    rows = rows.join(kept, ["_id", "_own"], "left_semi")  # structs of a null are equal, and the window needs no other shuffle
    nth = F.row_number().over(Window.partitionBy("_id", "_own").orderBy("row.text"))
    return rows.withColumn("_nth", nth).where("_nth = 1").select("row.*")


ORACLE = r"""
with base as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept,
       sha256(norm) as text_sha256
from base
"""
