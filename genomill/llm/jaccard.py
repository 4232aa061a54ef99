"""N-gram Jaccard join: documents whose sets of word shingles are similar, exactly.

1. Each text becomes a sorted array of 64-bit shingle hashes; equal sets are one node from then on.
2. Two sets can only be similar if they meet in the ``n - ceil(t * n) + 1`` first members of either,
   in any common order; the order is from rare to frequent by counts over all texts, so shingles
   that no other text has, which make no candidates, come first, and passages that many documents
   share come last.
3. Nodes that meet in a shingle are first compared with its smallest node: hashed bitmaps bound the
   overlap from above by bit counts, and pairs within the bound are compared exactly by
   intersecting the sorted arrays. What is still apart in a shingle's group goes into tiles of nodes
   of like size, and all pairs of tiles of like size are compared in the same way, the arrays being read
   from the shared folder: a task gives only links between nodes that its earlier links leave apart, so that
   what tiles make grows with their nodes, and not with the pairs of them that are similar or nearly so.

Groups are never held whole: they pass as sorted rows, a shingle of more than ``CROWD`` texts is dealt out over
several groups, and tiles have at most ``TILE`` nodes. Shingles are compared by 64-bit hashes: two that share one
count as equal, to the end.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .bytewise import U, Words, bounded, buffers, chain, mix, slices
from .components import components
from .files import Runs, Table, pack, part_of, sink, unpack, write

WIDTH = 5
SIMILAR = (80, 100)
#: Shingles that a task sorts together, and bytes of text for each range of fingerprints.
AT_ONCE = 2_000_000
TEXT_PER_PART = 16 << 20
#: A shingle of more documents than this is dealt out over several groups.
CROWD = 1_000
TILE = 1024
#: Ids and digests up to this many are sent to all tasks instead of shuffling texts.
SENT = 1_000_000
BITS = (2048, 32768)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    raw, at = buffers(texts)
    for _, _, part, offsets in slices(raw, at):
        words = Words(part, offsets)
        h = words.hashes()
        n = len(h)
        rolled = chain([h[k : n - width + 1 + k] for k in range(width)]) if n >= width else h[:0]
        for b, e in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if e - b >= width:
                yield np.unique(rolled[b : e - width + 1])
            elif e > b:
                yield chain([h[k : k + 1] for k in range(b, e)])
            else:
                yield h[:0]


def prefix_length(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """How many members of a set of n suffice to meet every similar set that isn't equal; 0: there is none."""
    part, whole = similar
    if n == 0 or (n * whole // part == n and (n - 1) * whole < part * (n + 1)):
        return 0
    return n - -(-part * n // whole) + 1


def bitmap(members: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each member's hash, in 64-bit words."""
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(mix(members) & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer words: bits of equal remainder fall together."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def overlap_bound(one: np.ndarray, one_n: int, others: np.ndarray, others_n: np.ndarray) -> np.ndarray:
    """No intersection of the sets is larger: each bit that only one has stands for a member that the other lacks."""
    alone = np.bitwise_count(one & ~others).sum(axis=1, dtype=np.int64)
    missing = np.bitwise_count(others & ~one).sum(axis=1, dtype=np.int64)
    return np.minimum(one_n - alone, others_n - missing)


def is_similar(common, n, m, similar: tuple[int, int] = SIMILAR):
    part, whole = similar
    return whole * common >= part * (n + m - common)


def _prints(batches, width: int, bits: int, parts: int):
    """Fingerprints of the shingles of each text, the upper ``bits`` of their hashes, packed by part; a text counts once for each."""
    sets = (members for batch in batches for members in shingle_sets(batch.column("text"), width))
    for members in _some(sets, AT_ONCE):
        found, n = np.unique(members >> U(64 - bits), return_counts=True)
        cuts = np.searchsorted(part_of(found << U(64 - bits), parts), np.arange(parts + 1))
        filled = np.flatnonzero(np.diff(cuts)).tolist()
        data = [_packed(found[cuts[p] : cuts[p + 1]], n[cuts[p] : cuts[p + 1]]) for p in filled]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])


def _packed(found: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted numbers as steps of 16 bits, a full step for those that are too far, and the counts that aren't 1."""
    steps = np.diff(found, prepend=U(0)).astype(np.int64)
    steps[0] = 0
    far, rest = np.divmod(steps, 0xFFFF)
    out = np.full(int(far.sum()) + len(steps), 0xFFFF, dtype=np.uint16)
    out[np.cumsum(far + 1) - 1] = rest
    several = np.flatnonzero(n > 1)
    return pack(found[:1], out, several, n[several])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, steps, several, more = unpack(data)
    steps = steps.astype(np.uint64)
    found = (np.cumsum(steps) + first[0])[steps != 0xFFFF]
    n = np.ones(len(found), dtype=np.int64)
    n[several.astype(np.int64)] = more
    return found, n


def _repeated(batches, bits: int, uri: str):
    """Writes, for each part, the fingerprints that several texts have, with how many; yields which parts have any."""
    got: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            got.setdefault(part, []).append(data)
    filled = []
    for part in sorted(got):
        found, n = (np.concatenate(x) for x in zip(*map(_unpacked, got.pop(part)), strict=True))
        order = np.argsort(found)
        found, n = found[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        n = np.add.reduceat(n, first)
        found = found[first][n > 1] << U(64 - bits)
        n = n[n > 1]
        if len(n):
            write(f"{uri}/{part:06d}.bin", [found, n.astype(np.min_scalar_type(int(n.max())))])
            filled.append(part)
    yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32())], ["part"])


def _frequent(docs: DataFrame, width: int) -> tuple[Table, int]:
    """How many texts have a shingle, for those that several have: arrays in the shared folder, which workers map.

    Fingerprints have some bits more than it takes to tell all shingles apart; where two fall
    together they only seem more frequent than they are.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // TEXT_PER_PART))
    bits = max(36, int(size).bit_length() + 4)
    uri = shared.place(spark, "shingles")
    rows = docs.select("text").mapInArrow(bounded(lambda b: _prints(b, width, bits, parts)), "part int, data binary")
    filled = rows.repartition(parts, "part").mapInArrow(bounded(lambda b: _repeated(b, bits, uri)), "part int").collect()  # part numbers
    return Table(uri, parts, {r.part for r in filled}), bits


def _some(arrays: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """Concatenations of about so many numbers."""
    held, n = [], 0
    for a in arrays:
        held.append(a)
        n += len(a)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _sets(docs: DataFrame, width: int, similar: tuple[int, int], crowd: int) -> DataFrame:
    """doc_id, n, digest of the set, prefix: those of its first members that other texts have, salt: each one's group if it has several."""
    table, bits = _frequent(docs, width)
    mask = U((1 << 64) - (1 << (64 - bits)))

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for first in range(0, len(batch), 1024):
                yield some(texts.slice(first, 1024), ids.slice(first, 1024))

    def some(texts, ids):
        sets = list(shingle_sets(texts, width))
        keys, where = np.unique(np.concatenate(sets) & mask if sets else np.zeros(0, np.uint64), return_inverse=True)
        often = table.find(keys, 1)[0][where]
        ends = np.cumsum([len(m) for m in sets])
        digests, prefixes, salts = [], [], []
        for members, end, doc in zip(sets, ends.tolist(), ids.to_pylist(), strict=True):
            digests.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
            n = often[end - len(members) : end]
            chosen = np.argsort(n, kind="stable")[: prefix_length(len(members), similar)]
            chosen = chosen[n[chosen] > 1]  # what no other text has meets none
            prefixes.append(members[chosen].view(np.int64))
            groups = n[chosen] // crowd + 1
            salts.append(np.where(groups > 1, 1 + (mix(np.array([doc or 0]).view(np.uint64)) >> U(1)).astype(np.int64) % groups, 0).astype(np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x))) for x in (prefixes, salts)]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(m) for m in sets], pa.int64()), pa.array(digests, pa.binary()), *lists], ["doc_id", "n", "digest", "prefix", "salt"])

    return docs.select("doc_id", "text").mapInArrow(bounded(run), "doc_id long, n long, digest binary, prefix array<long>, salt array<int>")


def _groups(batches):
    """Of rows sorted by (token, salt, node), those of groups of several; leader: the group's first node.

    A salt above 0 is one of several groups of its token, and its rows stay even if alone.
    """
    held, leader = None, None  # the last row, and the first node of its group if that is an earlier row
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "node")]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        yield from _led(cols, leader, False)
        token, salt, node = cols
        start = int(np.argmax((token == token[-1]) & (salt == salt[-1])))
        if start or leader is None:
            leader = node[start] if start < len(node) - 1 else None
        held = [c[-1:] for c in cols]
    if held is not None:
        yield from _led(held, leader, True)


def _led(cols, leader, final):
    token, salt, node = cols
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
    firsts = node[new]
    alone = new.copy()
    alone[:-1] &= new[1:]
    if leader is not None:
        firsts = np.concatenate([[leader], firsts[1:]])
        alone[0] = False
    keep = ~alone | (salt > 0)
    keep[-1] &= final
    if keep.any():
        lead = firsts[np.cumsum(new) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, salt, node, lead)], ["token", "salt", "node", "leader"])


def _texts(docs: DataFrame, nodes: DataFrame, how_many: int) -> DataFrame:
    """(node, text) of the documents that are nodes."""
    nodes = nodes.select(F.col("node").alias("doc_id"))
    if how_many <= SENT:
        nodes = F.broadcast(nodes)
    return docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are similar, by exact intersection."""

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 512):
                yield some(batch.slice(first, 512))

    def some(batch):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
        distinct = list(dict.fromkeys([*left, *right]))
        sets = dict(zip(distinct, shingle_sets(pa.array(distinct, pa.large_string()), width), strict=True))
        good = []
        for i, (x, y) in enumerate((sets[s], sets[t]) for s, t in zip(left, right, strict=True)):
            if is_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similar):
                good.append(i)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.int64()) for x in (a, b)], ["a", "b"])

    nodes = shared.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = shared.keep(_texts(docs, nodes, nodes.count()).distinct(), "texts")
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(bounded(run), "a long, b long").distinct()


def _within(pairs: DataFrame, maps: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for enough overlap."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            left, right = batch.column("map_a").to_pylist(), batch.column("map_b").to_pylist()
            sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 2)
            good = np.zeros(len(n), dtype=bool)
            for kind in np.unique(sizes, axis=0):
                rows = np.flatnonzero((sizes == kind).all(axis=1))
                x, y = (np.frombuffer(b"".join(side[i] for i in rows.tolist()), dtype=np.uint64).reshape(len(rows), -1) for side in (left, right))
                words = min(x.shape[1], y.shape[1])
                most = overlap_bound(fold(x, words), n[rows], fold(y, words), m[rows])
                good[rows] = is_similar(np.minimum(most, np.minimum(n[rows], m[rows])), n[rows], m[rows], similar)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    one, two = (maps.select(*[F.col(c).alias(t) for c, t in (("node", s), ("n", f"n_{s}"), ("map", f"map_{s}"))]) for s in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(bounded(run), "a long, b long").distinct()


MAPS = "node long, digest binary, n long, map binary, file long, at long"


def _maps(batches, width: int, uri: str):
    """Bitmaps of the sets of texts. The sets themselves go to a file of this attempt's own: which, and from which number on."""
    file, at, out = uuid.uuid4().int >> 66, 0, None
    try:
        for batch in batches:
            out = out or sink(f"{uri}/{file}.bin")
            digests, n, maps, places = [], [], [], []
            for members in shingle_sets(batch.column("text"), width):
                data = members.tobytes()
                out.write(data)
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                n.append(len(members))
                maps.append(bitmap(members, BITS[len(members) > 2 * BITS[0]]).tobytes())
                places.append(at)
                at += len(members)
            cols = [pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(maps, pa.binary()), pa.array([file] * len(n), pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *cols], [x.split()[0] for x in MAPS.split(", ")])
    finally:
        if out is not None:
            out.close()


#: What a tile has of each of its nodes, besides its bitmap.
EACH = ("nodes", "comps", "sizes", "files", "ats")
TILES = f"token long, tile long, pure boolean, lo long, hi long, {', '.join(f'{c} array<long>' for c in EACH)}, maps binary"


def _tiles(batches):
    """Rows sorted by token, whether of the largest component, and size: tiles of at most TILE rows."""
    held: list = []
    number = TaskContext.get().partitionId() << 40

    def flush():
        nonlocal number
        number += 1
        nodes, comps, sizes, maps, files, ats = (list(c) for c in zip(*(r[2:] for r in held), strict=True))
        return (held[0][0], number, not held[0][1], min(sizes), max(sizes), nodes, comps, sizes, files, ats, b"".join(maps))

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * len(EACH), pa.binary()]
        names = [x.split()[0] for x in TILES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        rows = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("token", "rest", "node", "comp", "n", "map", "file", "at")), strict=True):
            if held and (held[0][:2] != row[:2] or len(held) >= TILE or len(held[0][5]) != len(row[5])):
                rows.append(flush())
                held = []
            held.append(row)
        if rows:
            yield batch_of(rows)
    if held:
        yield batch_of([flush()])


def _common(members: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the others shares; all are sorted, and none is empty."""
    flat = np.concatenate(others)
    at = np.searchsorted(members, flat)
    at[at == len(members)] = 0
    starts = np.cumsum([0, *[len(o) for o in others[:-1]]])
    return np.add.reduceat((members[at] == flat).astype(np.int64), starts)


def _tile_links(batches, uri: str, similar: tuple[int, int]):
    """Links between nodes of two tiles: like size, within the bound, then by exact intersection.

    Nodes that earlier links of this task have joined count as one component, so there are fewer links than components.
    """
    sets = Runs(uri)
    joined: dict[int, int] = {}

    def root(comp: int) -> int:
        while (up := joined.get(comp)) is not None:
            joined[comp] = joined.get(up, up)
            comp = up
        return comp

    def roots(comps: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(comps, return_inverse=True)
        return np.array([root(c) for c in distinct.tolist()], dtype=np.int64)[where]

    for batch in batches:
        for r in range(len(batch)):
            one, two = ({c: batch.column(s + c)[r].values.to_numpy() for c in EACH} for s in ("a_", "b_"))
            x, y = (np.frombuffer(batch.column(s + "maps")[r].as_py(), dtype=np.uint64).reshape(len(t["nodes"]), -1) for s, t in (("a_", one), ("b_", two)))
            words = min(x.shape[1], y.shape[1])
            x, y = fold(x, words), fold(y, words)
            same = batch.column("same")[r].as_py()
            mine = roots(one["comps"])
            theirs = mine if same else roots(two["comps"])
            sizes, out = two["sizes"], []
            for i, n in enumerate(one["sizes"].tolist()):
                others = np.flatnonzero((theirs != mine[i]) & is_similar(np.minimum(sizes, n), n, sizes, similar))
                if same:
                    others = others[others > i]
                if len(others):
                    others = others[is_similar(overlap_bound(x[i], n, y[others], sizes[others]), n, sizes[others], similar)]
                while len(others):
                    some = others[: max(1, int(np.searchsorted(np.cumsum(sizes[others[:32]]), AT_ONCE)))]
                    found = [sets.get(int(two["files"][j]), int(two["ats"][j]), int(sizes[j])) for j in some.tolist()]
                    members = sets.get(int(one["files"][i]), int(one["ats"][i]), n)
                    for j in some[is_similar(_common(members, found), n, sizes[some], similar)].tolist():
                        comp, to = int(theirs[j]), int(mine[i])
                        if comp != to:
                            joined[comp] = to
                            out.append((int(one["nodes"][i]), int(two["nodes"][j])))
                            mine[mine == comp] = to
                            theirs[theirs == comp] = to
                    others = others[len(some) :]
                    others = others[theirs[others] != mine[i]]
            if out:
                a, b = np.array(out, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
    sets.close()


def near_duplicates(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A text of fewer words than ``width`` has its whole sequence as its only shingle; a null text
    or one without words has none and links with nothing, also not with another such text.
    component_id is the smallest doc_id reachable by links, itself included. A row with a null
    doc_id links with nothing and has a null component_id. Rows that repeat a doc_id get their
    component each by its own text. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    docs = docs.select("doc_id", "text")
    sets = shared.keep(_sets(docs, width, similar, crowd), "sets")
    known = sets.where("n > 0 and doc_id is not null")
    classes = shared.keep(known.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    copies = known.select("doc_id", "digest").join(classes, "digest").where("doc_id <> node").select("doc_id", "digest").distinct()
    copies = shared.keep(copies, "copies")
    copies = F.broadcast(copies) if copies.count() <= SENT else copies
    one_each = known.join(copies, ["doc_id", "digest"], "left_anti")

    rows = one_each.select(F.col("doc_id").alias("node"), F.explode(F.arrays_zip("prefix", "salt")).alias("x")).select(F.col("x.prefix").alias("token"), F.col("x.salt").alias("salt"), "node")
    rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    groups = rows.mapInArrow(bounded(_groups), "token long, salt int, node long, leader long")
    groups = shared.keep(groups, "groups")

    stars = groups.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    heads = groups.where("salt > 0").select("token", "leader").distinct()
    first = heads.groupBy("token").agg(F.min("leader").alias("first"), F.count(F.lit(1)).alias("several")).where("several > 1").drop("several")
    heads = heads.join(first, "token").where("leader <> first").select(F.col("first").alias("a"), F.col("leader").alias("b"))
    pairs = shared.keep(stars.unionByName(heads).distinct(), "pairs")
    nodes = shared.keep(groups.select("node").distinct(), "grouped")
    uri = shared.place(spark, "members")
    maps = _texts(docs, nodes, nodes.count()).mapInArrow(bounded(lambda b: _maps(b, width, uri)), MAPS)
    maps = shared.keep(maps.groupBy("node", "digest").agg(F.min(F.struct("file", "at", "n", "map")).alias("of")).select("node", "of.*"), "maps")
    links = shared.keep(_verified(shared.keep(_within(pairs, maps, similar), "within"), docs, width, similar), "links")
    labels = shared.keep(components(links), "labels")

    # What is still apart in a token's group. Crowded tokens keep their salts: no join or tile has all of their rows in one task.
    apart = groups.select("token", "salt", "node").distinct().join(labels, "node", "left").select("token", "salt", "node", F.coalesce("component", "node").alias("comp"))
    by_comp = apart.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("salt").alias("salts"))
    mixed = by_comp.groupBy("token").agg(F.sum("k").alias("all"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp"))["comp"].alias("main"), F.max("salts").alias("salts"))
    # in a group of two the pair has been compared
    mixed = mixed.where("comps > 1 and all > 2").select("token", "main", F.explode(F.when(F.col("salts") > 0, F.sequence(F.lit(1), F.col("salts"))).otherwise(F.array(F.lit(0)))).alias("salt"))
    apart = apart.join(mixed, ["token", "salt"]).withColumn("rest", F.col("comp") != F.col("main")).drop("main")
    apart = shared.keep(apart, "apart")
    if not apart.isEmpty():
        part, whole = similar
        # Ranges of (token, size): a crowded token's rows lie in several tasks, each with sizes of its own.
        tiles = apart.join(maps, "node").select("token", "rest", "node", "comp", "n", "map", "file", "at")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tiles = tiles.repartitionByRange(parts, "token", "rest", "n", "node").sortWithinPartitions("token", "rest", "n", "node")
        tiles = shared.keep(tiles.mapInArrow(bounded(_tiles), TILES), "tiles")
        heads = tiles.select("token", "tile", "pure", "lo", "hi")  # which tiles meet is decided without their bitmaps
        one, two = (heads.select("token", *[F.col(c).alias(f"{t}_{c}") for c in heads.columns if c != "token"]) for t in "ab")
        near = (F.col("a_hi") * whole >= F.col("b_lo") * part) & (F.col("b_hi") * whole >= F.col("a_lo") * part)
        both = one.join(two, "token").where((F.col("a_tile") <= F.col("b_tile")) & ~(F.col("a_pure") & F.col("b_pure")) & near).select("a_tile", "b_tile")
        for t in "ab":
            both = both.join(tiles.select(*[F.col(c).alias(f"{t}_{c}") for c in ("tile", *EACH, "maps")]), f"{t}_tile")
        both = both.withColumn("same", F.col("a_tile") == F.col("b_tile"))
        more = both.mapInArrow(bounded(lambda b: _tile_links(b, uri, similar)), "a long, b long").distinct()
        more = shared.keep(more, "more-links")
        if not more.isEmpty():
            labels = shared.keep(components(links.unionByName(more)), "all-labels")

    named = sets.select("doc_id", "n", "digest").join(classes.select("digest", "node"), "digest", "left").join(labels, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, with all their columns.

    Rows with a null doc_id or without words stay; of rows that repeat a kept document one stays.
    A doc_id that different texts share says nothing of either: one row of each of its texts stays.
    """
    kept = near_duplicates(docs, **options).where("component_id = doc_id").select("doc_id")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    clashing = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("doc_id")
    kept = kept.unionByName(clashing).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    known = rows.join(kept, F.col("row.doc_id") == kept["doc_id"], "left_semi")
    own = F.sha2(F.coalesce("row.text", F.lit("")), 256)
    known = known.withColumn("nth", F.row_number().over(Window.partitionBy("row.doc_id", own).orderBy("row.text"))).where("nth = 1").drop("nth")
    return known.unionByName(rows.where("row.doc_id is null")).select("row.*")
