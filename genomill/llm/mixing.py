"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted ``target / source size`` times, at most twice. The whole part
is taken outright; the fractional part is an inclusion probability. The flight phase of the cube
method moves three fractional probabilities at a time along the null space of two constraints (the
number of documents and their words), until each but two of a block is 0 or 1. What blocks leave
goes through further flights until one block per source remains, whose last fractional documents
are the landing problem: of all their roundings, the one closest to the wanted words is taken.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .bytewise import U, mix

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Per source of ``sizes`` (source, size): source, source_size, n_docs, target.

    Sources rank by code point, null last, and the weights repeat over the ranks. A target is
    ``level * weight``, or ``most`` times the source's size where that is less; the level is the one
    that spends the budget. Sources without words get 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # From the source that is full first on: all before it are full, it and those after it share the rest.
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    level = (F.lit(float(budget)) * total - before) / after
    per = per.withColumn("level", level)
    free = F.col("level") * F.col("weight") < F.col("cap")
    first = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")).alias("s"))).over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("final", first["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def flight(p: np.ndarray, z: np.ndarray, draw: np.ndarray, done: int = 2) -> np.ndarray:
    """Probabilities after the flight; at most ``done`` of them are neither 0 nor 1.

    Sums of p and of p * z stay as they were. ``draw``: a number in [0, 1) for each step.
    """
    p = p.copy()
    eps = 1e-12
    live: list[int] = []
    steps = 0
    waiting = iter(np.flatnonzero((p > eps) & (p < 1 - eps)).tolist())
    while True:
        while len(live) < 3 and (i := next(waiting, None)) is not None:
            live.append(i)
        if len(live) < 3:
            break
        a, b, c = live
        u = [z[b] - z[c], z[c] - z[a], z[a] - z[b]]
        if u[0] == u[1] == u[2] == 0:
            u = [1.0, -1.0, 0.0]
        up = down = np.inf
        for i, d in zip(live, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if draw[steps % len(draw)] * (up + down) < down else -down
        steps += 1
        for i, d in zip(live, u, strict=True):
            p[i] += step * d
            if p[i] < eps:
                p[i] = 0.0
            elif p[i] > 1 - eps:
                p[i] = 1.0
        live = [i for i in live if 0 < p[i] < 1]
    return p


def landing(p: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Rounds the few fractional probabilities that a flight left, closest in words and then in documents."""
    at = np.flatnonzero((p > 0) & (p < 1))
    best = min(itertools.product((0.0, 1.0), repeat=len(at)), key=lambda r: (abs(float(np.dot(np.array(r) - p[at], z[at]))), abs(sum(r) - p[at].sum()), r), default=())
    p = p.copy()
    p[at] = best
    return p


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, block: int = 4096, seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, times.

    size: number of words (null text: 0); times: how often the mix takes the document, at most
    ``most`` rounded up; taken = times * size. Documents without words are taken 0 times. A null
    source is a source. Repeated rows count as documents of their own; null ids are allowed. The
    same rows give the same mix, however they are partitioned. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = shared.keep(sizes, "sizes")
    per = shared.keep(targets(sizes, weights, budget, most), "targets")
    per_doc = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sizes.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Rows that repeat one another are told apart by their number.
    same = Window.partitionBy("doc_id", "source", "size").orderBy("target")
    all_rows = joined.withColumn("copy", F.row_number().over(same)).withColumn("wanted", per_doc)
    all_rows = all_rows.withColumn("whole", F.when(F.col("size") > 0, F.floor("wanted")).otherwise(0)).withColumn("p", F.when(F.col("size") > 0, F.col("wanted") - F.floor("wanted")).otherwise(0.0))
    key = F.xxhash64("doc_id", "copy", F.lit(seed))
    state = all_rows.select("doc_id", "source", "size", "copy", "source_size", "target", "whole", "p", key.alias("key"), "n_docs")
    state = state.withColumn("blocks", F.ceil(F.col("n_docs") / block)).drop("n_docs")

    most_docs = per.agg(F.max("n_docs")).first()[0] or 0
    rounds = 1
    while most_docs > block:
        most_docs = 2 * -(-most_docs // block)
        rounds += 1

    def fly(last: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["key", "doc_id", "copy", "size"], kind="stable").reset_index(drop=True)
            z = group["size"].to_numpy(dtype=np.float64)
            draw = mix(group["key"].to_numpy(dtype=np.int64).view(np.uint64) + U(seed)) / 2.0**64
            p = flight(group["p"].to_numpy(dtype=np.float64), z, draw)
            if last:
                p = landing(p, z)
            return group.assign(p=p)

        return run

    decided = None
    for r in range(rounds):
        last = r == rounds - 1
        state = state.withColumn("block", F.pmod(F.xxhash64("key", F.lit(r)), F.greatest("blocks", F.lit(1))))
        out = state.groupBy("source", "block").applyInPandas(fly(last), state.schema)
        if last:
            decided = out if decided is None else decided.unionByName(out)
            break
        out = shared.keep(out, f"flight{r}")
        fixed, state = out.where("p = 0 or p = 1"), out.where("p > 0 and p < 1").drop("block")
        state = state.withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        decided = fixed if decided is None else decided.unionByName(fixed)
    times = (F.col("whole") + F.col("p")).cast("long")
    return decided.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), "source", "copy")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with all their columns.

    Nulls and repeated rows: as in ``mix_sources``. Rows that repeat a document stay together.
    """
    plan = mix_sources(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("row")).withColumn("of", size)
    same = F.col("row.doc_id").eqNullSafe(plan["doc_id"]) & F.col("row.source").eqNullSafe(plan["source"]) & (F.col("of") == plan["size"])
    rows = rows.join(plan, same)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("row.doc_id", "row.source", "of").orderBy("row.text")))
    rows = rows.withColumn("share", F.expr("times div rows + if(nth <= times % rows, 1, 0)")).where("share > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("share").cast("int")))).select("row.*")
