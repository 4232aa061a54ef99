"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to regions by median splits of the widest dimension, fitted on a sample of bounded size, and
regions of too many vectors are dealt out over several shards. A shard's tree splits in the same way, and each leaf
has a tight bounding box; no vector in a box has a larger inner product with a query than the sum of the better
corner's products. Leaves are visited from the best bound down, until the bound falls below the query's kth score.
Each query first searches the shard that it lies in; with the kth score that it finds there it goes to those regions
only whose tight box, over all their vectors, reaches that score.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .bytewise import bounded

K = 20
EVERY = 20
LEAF = 128
#: Vectors of a shard, and queries that go through a shard together.
SHARD = 16_384
BLOCK = 4_096
#: Vectors that the splits into regions are fitted on (expected; all vectors are placed), and bytes of all regions' boxes.
SAMPLE = 20_000
BOXES = 32 << 20
#: Cells whose numbers of blocks are sent to all tasks; more are joined.
MOST_CELLS = 1_000_000
SCALE = 64
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, uid, dims and floor(64 * x) of each component, as doubles, of vectors that have only finite components."""
    for batch in batches:
        vectors = batch.column("embedding")
        whole = pc.fill_null(pc.list_value_length(vectors), 0)
        flat = pc.list_flatten(vectors).cast(pa.float64())
        sizes = whole.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = np.floor(flat.to_numpy(zero_copy_only=False) * SCALE)  # null becomes NaN
        ends = np.cumsum(sizes)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
        good = (bad[ends] == bad[ends - sizes]) & batch.column("embedding").is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(good)
        data = [numbers[ends[i] - sizes[i] : ends[i]].tobytes() for i in rows.tolist()]
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take).cast(pa.int64()), batch.column("uid").take(take), pa.array(sizes[rows], pa.int64()), pa.array(data, pa.binary())], ["vec_id", "uid", "dims", "v"])


class Tree:
    """Leaves of a KD-tree over the rows of ``vectors``: where each begins and ends, and its box."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        n = len(vectors)
        order = np.arange(n)
        self.begins, self.ends = [], []
        stack = [(0, n)]
        while stack:
            b, e = stack.pop()
            some = vectors[order[b:e]]
            spread = some.max(axis=0) - some.min(axis=0) if e > b and some.shape[1] else np.zeros(0)
            if e - b <= leaf or not len(spread) or spread.max() == 0:
                self.begins.append(b)
                self.ends.append(e)
                continue
            half = (e - b) // 2
            part = np.argpartition(some[:, spread.argmax()], half)
            order[b:e] = order[b:e][part]
            stack += [(b + half, e), (b, b + half)]
        self.order = order
        self.vectors = vectors[order]
        boxes = [self.vectors[b:e] for b, e in zip(self.begins, self.ends, strict=True)]
        self.low = np.array([x.min(axis=0) for x in boxes])
        self.high = np.array([x.max(axis=0) for x in boxes])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No vector of a leaf has a larger inner product with a query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: list[int | None], k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, scores): the up to k best rows for each query that score at least its ``floor``, if it has one.

    Ties go to the smaller id, then to the smaller uid; rows of uid ``own`` don't count. Scores are exact.
    """
    exact = np.float64
    most = (np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0)) * max(vectors.shape[1], 1)
    if most >= 2**53:
        exact = object
        vectors, queries = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (vectors, queries))
    if not len(vectors) or not len(queries):
        return
    tree = Tree(vectors)
    bounds = tree.bounds(queries)
    order = np.argsort(-bounds.astype(np.float64), axis=1, kind="stable") if exact is not object else np.array([sorted(range(bounds.shape[1]), key=lambda j: -row[j]) for row in bounds])
    n_queries, n_leaves = bounds.shape
    best = np.full((n_queries, k), -np.inf if exact is not object else -(1 << 200), dtype=exact)
    where = np.full((n_queries, k), -1, dtype=np.int64)
    kth = np.array([(-(1 << 200) if exact is object else -np.inf) if x is None else x for x in floor], dtype=exact)
    ids, uids = ids[tree.order], uids[tree.order]
    tie = np.empty(len(ids), dtype=np.int64)
    tie[np.lexsort((uids, ids))] = np.arange(len(ids))  # the place of each row among all by id and uid
    alive = np.arange(n_queries)
    for r in range(n_leaves):
        leaf = order[alive, r]
        go = bounds[alive, leaf] >= kth[alive]
        alive, leaf = alive[go], leaf[go]  # later bounds of a query are no better
        if not len(alive):
            break
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by])) + 1
        for some in np.split(by, cuts):
            j = leaf[some[0]]
            b, e = tree.begins[j], tree.ends[j]
            q = alive[some]
            got = queries[q] @ tree.vectors[b:e].T
            if exact is object:
                got = np.array([[min(max(x, NONE), LAST) for x in row] for row in got], dtype=object).reshape(got.shape)
            got[uids[None, b:e] == own[q][:, None]] = -np.inf if exact is not object else -(1 << 200)
            hit = (got >= kth[q][:, None]).any(axis=1)
            q, got = q[hit], got[hit]
            if not len(q):
                continue
            scores = np.concatenate([best[q], got], axis=1)
            rows = np.concatenate([where[q], np.broadcast_to(np.arange(b, e), got.shape)], axis=1)
            places = np.where(rows >= 0, tie[rows], LAST)
            if exact is object:
                top = np.array([sorted(range(scores.shape[1]), key=lambda c, s=s, p=p: (-s[c], p[c]))[:k] for s, p in zip(scores, places, strict=True)])
            else:
                top = np.lexsort((places, -scores), axis=1)[:, :k]
            best[q] = np.take_along_axis(scores, top, axis=1)
            where[q] = np.take_along_axis(rows, top, axis=1)
            kth[q] = np.maximum(kth[q], best[q, k - 1])
    for q in range(n_queries):
        good = (where[q] >= 0) & (best[q] >= kth[q]) & (best[q] > (-np.inf if exact is not object else -(1 << 200)))
        if good.any():
            yield q, tree.order[where[q][good]], best[q][good]


class Splits:
    """Median splits of a space: for each node its dimension (-1: a region), its cut, and its two children or its region."""

    def __init__(self, vectors: np.ndarray, regions: int):
        self.dim, self.cut, self.child = [], [], []
        parts: list[tuple[int, np.ndarray]] = [(0, vectors)]
        waiting, leaves = [(-len(vectors), 0)], 1
        self._node()
        held = dict(parts)
        while waiting and leaves < regions:  # the largest part is split first
            _, node = heapq.heappop(waiting)
            some = held.pop(node)
            spread = some.max(axis=0) - some.min(axis=0) if len(some) and some.shape[1] else np.zeros(0)
            if not len(spread) or not spread.max() > 0:
                continue
            d = int(spread.argmax())
            column = some[:, d]
            cut = np.partition(column, len(column) // 2)[len(column) // 2]
            if cut == column.min():  # equal values stay together: those above it go
                cut = column[column > cut].min()
            above = column >= cut
            self.dim[node], self.cut[node], self.child[node] = d, float(cut), len(self.dim)
            for mine in (some[~above], some[above]):
                new = self._node()
                held[new] = mine
                heapq.heappush(waiting, (-len(mine), new))
            leaves += 1
        for i, node in enumerate(n for n, d in enumerate(self.dim) if d < 0):
            self.child[node] = i
        self.dim, self.child, self.cut = np.array(self.dim), np.array(self.child), np.array(self.cut)

    def _node(self) -> int:
        self.dim.append(-1)
        self.cut.append(0.0)
        self.child.append(0)
        return len(self.dim) - 1

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        at = np.zeros(len(vectors), dtype=np.int64)
        going = np.flatnonzero(self.dim[at] >= 0)
        while len(going):
            node = at[going]
            at[going] = self.child[node] + (vectors[going, self.dim[node]] >= self.cut[node])
            going = going[self.dim[at[going]] >= 0]
        return self.child[at]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), dims)


def _by_dims(batches, size: int = 1024):
    """Slices of batches whose vectors have the same number of components."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            mine = batch.filter(pa.array(dims == d))
            for first in range(0, len(mine), size):
                yield d, mine.slice(first, size)


def _placed(batches, splits: dict[int, Splits]):
    for d, some in _by_dims(batches, 8192):
        region = splits[d].place(_matrix(some.column("v"), d)) if d in splits else np.zeros(len(some), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(region)], [*some.schema.names, "region"])


def _sent(batches, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """A row for each region that a query may find better rows in."""
    for d, part in _by_dims(batches):
        regions, low, high = boxes[d]
        size = max(1, (1 << 21) // len(regions))
        for some in (part.slice(first, size) for first in range(0, len(part), size)):
            q = _matrix(some.column("v"), d)
            floor = some.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN, which no comparison drops
            with np.errstate(over="ignore", invalid="ignore"):
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-9
                which, to = np.nonzero(~(bound + slack < floor[:, None]))
            take = some.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*take.columns, pa.array(regions[to])], [*take.schema.names, "to"])


def _corners(key, table):
    """The box around several boxes."""
    d = key[0].as_py()
    low, high = (_matrix(table[c].combine_chunks(), d) for c in ("low", "high"))
    return pa.table({"dims": [d], "region": [key[1].as_py()], "low": [low.min(axis=0).tobytes()], "high": [high.max(axis=0).tobytes()]}, schema=pa.schema([("dims", pa.int64()), ("region", pa.int64()), ("low", pa.binary()), ("high", pa.binary())]))


FOUND = "query_uid long, query_id long, vec_id long, uid long, score long"
BOX = "dims long, region long, low binary, high binary"


def _cell(k: int, box: bool = False):
    """Searches the queries of the right side in the shard of the left side; ``box``: a row with the shard's corners as well."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dims = left["dims"][0].as_py() if len(left) else 0
        vectors = np.frombuffer(b"".join(left["v"].to_pylist()), dtype=np.float64).reshape(len(left), dims)
        queries = np.frombuffer(b"".join(right["v"].to_pylist()), dtype=np.float64).reshape(len(right), dims if len(left) else -1) if len(right) and len(left) else np.zeros((0, dims))
        ids = pc.fill_null(left["vec_id"], LAST).to_numpy()
        uids = left["uid"].to_numpy()
        own = right["uid"].to_numpy()
        floor = right["floor"].to_pylist()
        out: list[list] = [[], [], [], [], []]
        real, query_ids = left["vec_id"].to_pylist(), right["vec_id"].to_pylist()
        for q, rows, scores in search(vectors, ids, uids, queries, own, floor, k):
            out[0] += [own[q].item()] * len(rows)
            out[1] += [query_ids[q]] * len(rows)
            out[2] += [real[i] for i in rows.tolist()]
            out[3] += uids[rows].tolist()
            out[4] += [int(s) for s in scores.tolist()]
        found = pa.table([pa.array(c, pa.int64()) for c in out], names=["query_uid", "query_id", "vec_id", "uid", "score"])
        if not box:
            return found
        n, place = len(found), (key[0].as_py(), key[1].as_py())
        corners = [vectors.min(axis=0).tobytes(), vectors.max(axis=0).tobytes()] if len(vectors) else [None, None]
        extra = [pa.array([None] * n + [x], t) for x, t in zip([*place, *corners], (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        one = [pa.concat_arrays([c.combine_chunks(), pa.nulls(1, pa.int64())]) for c in found.columns]
        return pa.table([*one, *extra], names=[*found.column_names, "dims", "region", "low", "high"])

    return run


def _fitted(key, table):
    d = key[0].as_py()
    order = np.argsort(table["uid"].to_numpy(), kind="stable")
    splits = Splits(_matrix(table["v"].combine_chunks(), d)[order], table["regions"][0].as_py())
    return pa.table({"dims": [d], "splits": [pickle.dumps(splits)]})


def _anew(df: DataFrame) -> DataFrame:
    """The same columns as new ones, for joins of a table with itself."""
    return df.toDF(*df.columns)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k best rows for each row of ``vectors`` whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    score: inner product of floor(64 * x) of the components. Candidates are all rows of the same
    number of components but the query's own row; fewer than k give fewer ranks. Ties go to the
    smaller vec_id, null last, and then to the row that was read first. Rows that repeat a vec_id are
    queries and candidates of their own. Vectors that are null or hold a null or non-finite
    component take no part; a null vec_id is no query. Scores beyond a long are held at its ends, and so tie.
    """
    spark = vectors.sparkSession
    shared.ship(spark)
    rows = vectors.select("vec_id", "embedding").withColumn("uid", F.monotonically_increasing_id())
    rows = shared.keep(rows.mapInArrow(scaled, "vec_id long, uid long, dims long, v binary"), "vectors")
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
    regions = F.least(F.ceil(F.col("n") / shard), F.lit(BOXES) / (16 * F.greatest("dims", F.lit(1)))).cast("long")
    sizes = sizes.select("dims", "n", F.when(F.col("dims") > 0, F.greatest(regions, F.lit(1))).otherwise(1).alias("regions")).where("regions > 1")
    drawn = rows.join(F.broadcast(sizes), "dims")  # a row for each length of many vectors
    drawn = drawn.where(F.pmod(F.xxhash64("uid", F.lit(7)), F.col("n")) < SAMPLE).select("dims", "regions", "uid", "v")
    trees = drawn.groupBy("dims").applyInArrow(_fitted, "dims long, splits binary").collect()  # two numbers for each region
    splits = spark.sparkContext.broadcast({r.dims: pickle.loads(r.splits) for r in trees})
    rows = rows.mapInArrow(bounded(lambda b: _placed(b, splits.value)), "vec_id long, uid long, dims long, v binary, region long")
    cells = rows.groupBy("dims", "region").agg(F.ceil(F.count(F.lit(1)) / shard).cast("long").alias("shards"))
    cells = shared.keep(cells, "regions")  # as many rows as there are regions
    rows = rows.join(F.broadcast(cells), ["dims", "region"]).withColumn("shard", F.pmod(F.xxhash64("uid"), F.col("shards"))).drop("shards")
    rows = shared.keep(rows, "placed")
    queries = rows.where(F.col("vec_id") % every == 0)

    cell = ["dims", "region", "shard"]
    home = rows.select(*cell, "vec_id", "uid", "v").groupBy(*cell)
    at_home = _anew(queries.select(*cell, "vec_id", "uid", "v", F.lit(None).cast("long").alias("floor"))).groupBy(*cell)
    near = shared.keep(home.cogroup(at_home).applyInArrow(_cell(k, box=True), f"{FOUND}, {BOX}"), "near")
    boxes: dict[int, tuple] = {}
    corners = near.where("low is not null").select("dims", "region", "low", "high").groupBy("dims", "region").applyInArrow(_corners, BOX)
    found = corners.collect()  # BOXES bytes for each length of vectors
    for d in sorted({r.dims for r in found}):
        mine = [r for r in found if r.dims == d]
        boxes[d] = (np.array([r.region for r in mine]), *(np.array([np.frombuffer(r[c], dtype=np.float64) for r in mine]) for c in ("low", "high")))
    near = near.where("query_uid is not null").select("query_uid", "query_id", "vec_id", "uid", "score")
    floors = near.groupBy(F.col("query_uid").alias("uid")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))

    known = spark.sparkContext.broadcast(boxes)
    sent = queries.join(floors, "uid", "left").select("dims", "region", "shard", "vec_id", "uid", "v", "floor")
    sent = sent.mapInArrow(bounded(lambda b: _sent(b, known.value)), "dims long, region long, shard long, vec_id long, uid long, v binary, floor long, to long")
    sent = sent.join(F.broadcast(cells.select("dims", F.col("region").alias("to"), "shards")), ["dims", "to"])
    sent = sent.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).where("`to` <> region or _s <> shard")
    sent = shared.keep(sent.select("dims", F.col("to").alias("region"), F.col("_s").alias("shard"), "vec_id", "uid", "v", "floor"), "sent")
    blocks = sent.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    blocks = shared.keep(blocks, "blocks")
    blocks = F.broadcast(blocks) if blocks.count() <= MOST_CELLS else blocks
    sent = sent.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")))
    sent = _anew(sent.select(*cell, "block", "vec_id", "uid", "v", "floor")).groupBy(*cell, "block")
    spread = rows.join(blocks, cell).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select(*cell, "block", "vec_id", "uid", "v").groupBy(*cell, "block")
    far = spread.cogroup(sent).applyInArrow(_cell(k), FOUND)

    best = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    found = near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 20
"""
