"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped for scoring.

Tokens are words in lower case and one end after each text; each text is preceded by ``order - 1``
begins. Tasks count the n-grams of their texts, ranges of hashes of the token before the last are merged, and each
range becomes a tree of contexts with what follows them in the shared folder. From distinct n-grams follow
the continuation counts of the next lower order, in the same range down to two tokens; n-grams that start with a
begin keep their own counts. Sums by context (total, n-grams seen once, twice, more often) follow there too, but for
contexts that end in a frequent token: its n-grams are dealt out by their last token as well, and their sums meet in
sorted arrays of hashes, as single tokens do. Nothing is pruned.
What reaches the driver are counts of counts and frequent tokens, at most two a part. Words are known by 64-bit hashes.

    P_k(w | h) = (c(hw) - D(c(hw))) / c(h.) + (D1 n1(h.) + D2 n2(h.) + D3 n3+(h.)) / c(h.) * P_k-1(w | h')
    P_0(w) = 1 / (V + 1)
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .bytewise import U, Words, bounded, buffers, chain, crc_remainder, slices
from .contexts import Grown, Tree, bundle, packed, small
from .files import Table, pack, part_of, read, unpack, write

BEGIN, END = U(0x5BD1E9955BD1E995), U(0xC2B2AE3D27D4EB4F)
#: Bytes of text for each range of hashes.
TEXT_PER_PART = 16 << 20
#: Groups of parts that are counted one after the other.
TURNS = 2
ROWS = "kind string, part int, data binary"


def _rows(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["kind", "part", "data"])


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, ends included, and the offsets of the texts in them."""
    n = len(words.bounds) - 1
    bounds = words.bounds + np.arange(n + 1)
    out = np.empty(bounds[-1], dtype=np.uint64)
    ends = bounds[1:] - 1
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner], out[ends] = words.hashes(), END
    return out, bounds


def grams(flat: np.ndarray, bounds: np.ndarray, order: int, begin=BEGIN) -> list[np.ndarray]:
    """Columns of the n-gram that ends in each token: the token last, begins before the text's first."""
    place = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [flat]
    for back in range(1, order):
        column = np.full(len(flat), begin, dtype=flat.dtype)
        column[back:] = flat[:-back]
        column[place < back] = begin
        out.insert(0, column)
    return out


def _squeezed(ascending: np.ndarray, *others: np.ndarray) -> bytes:
    """Arrays as compressed bytes, the first by its differences; the bytes of equal worth of an array lie together."""
    arrays = [np.diff(ascending, prepend=ascending.dtype.type(0)), *others]
    arrays = [a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in arrays]
    planes = b"".join(a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    head = b"".join(struct.pack("<BQ", a.itemsize, len(a)) for a in arrays)
    return struct.pack("<BQ", len(arrays), len(planes)) + head + pa.compress(planes, codec="zstd", asbytes=True)


def _loosened(data: bytes) -> list[np.ndarray]:
    k, size = struct.unpack_from("<BQ", data)
    planes, at, out = pa.decompress(data[9 + 9 * k :], decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for i in range(k):
        width, n = struct.unpack_from("<BQ", data, 9 + 9 * i)
        a = np.frombuffer(planes, np.uint8, width * n, at).reshape(width, n).T
        out.append(np.ascontiguousarray(a).view(f"<u{width}").reshape(n))
        at += width * n
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _place(columns: list[np.ndarray], frequent: np.ndarray) -> np.ndarray:
    """What says in which part an n-gram lies: the token before its last, with the last one where that is frequent."""
    if len(columns) == 1:
        return columns[0]
    place = columns[-2].copy()
    rows = np.flatnonzero(_among(place, frequent))
    place[rows] = chain([c[rows] for c in columns[-2:]])
    return place


def _among(hashes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each is one of the sorted hashes ``some``."""
    if not len(some):
        return np.zeros(len(hashes), dtype=bool)
    return some[np.minimum(np.searchsorted(some, hashes), len(some) - 1)] == hashes


def _numbered(flat: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted hashes of the texts' words and the begin, and the columns of ``grams`` as numbers into them."""
    words, where = np.unique(np.append(flat, BEGIN), return_inverse=True)
    return words, grams(where[:-1], bounds, order, where[-1])


def _shipped(held: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]], parts: int) -> list[tuple[str, int, bytes]]:
    """Distinct n-grams of several lots of words, columns of numbers into them and parts, with their counts, by part.

    Within a part each word's hash is written once, and rows are in order of their words.
    """
    words = np.unique(np.concatenate([w for w, _, _ in held]))
    lots = []
    for own, numbers, _ in held:
        to = np.searchsorted(words, own)
        lots.append([to[c] for c in numbers])
    columns = [np.concatenate(c) for c in zip(*lots, strict=True)]
    part = np.concatenate([p for _, _, p in held])
    key = packed(columns, len(words).bit_length())
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count, picked = np.diff(first, append=len(key)), order[first]
    part = small(part[picked])
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    out, to = [], np.zeros(len(words), np.int64)
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        rows = by[cuts[p] : cuts[p + 1]]
        mine = [c[picked[rows]] for c in columns]
        used = np.zeros(len(words), dtype=bool)
        for c in mine:
            used[c] = True
        names = np.flatnonzero(used)
        to[names] = np.arange(len(names))
        places = [to[c] for c in mine]
        out.append(("n", p, _squeezed(words[names], np.diff(places[0], prepend=0), *places[1:], count[rows])))
    return out


def _received(data: list[bytes], width: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted hashes of words, columns of numbers into them, and counts, of the rows of several messages of a part."""
    rows = [_loosened(d) for d in data]
    names = np.unique(np.concatenate([r[0] for r in rows]))
    columns, counts = [], []
    for own, first, *arrays in rows:
        to = np.searchsorted(names, own)
        columns.append([to[w] for w in (np.cumsum(first, dtype=np.int64), *arrays[: width - 1])])
        counts.append(arrays[width - 1].astype(np.int64))
    return names, [np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate(counts)


def _learned(batches, modulus: int, held_out: int):
    """Token hashes and offsets of the texts to learn from, a slice at a time."""
    for batch in batches:
        learn = crc_remainder(batch.column("doc_id").to_pylist(), modulus) != held_out
        raw, at = buffers(batch.column("text").filter(pa.array(learn)))
        for _, _, part, offsets in slices(raw, at):
            yield tokens(Words(part, offsets))


def _often(batches, parts: int, modulus: int, held_out: int):
    """Tokens that may come before the last one of more than 1 / (2 parts) of all n-grams, and, by null, how many n-grams there are."""
    for flat, bounds in _learned(batches, modulus, held_out):
        hashes, n = np.unique(flat, return_counts=True)
        hashes[hashes == END] = BEGIN  # a text has one n-gram less than tokens after its own, and one after a begin
        many = n * 4 * parts >= len(flat)
        keys = pa.concat_arrays([pa.array(hashes[many].view(np.int64)), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([keys, pa.array([*n[many].tolist(), len(flat)], pa.int64())], ["token", "n"])


def _counted(batches, order: int, parts: int, modulus: int, held_out: int, frequent: np.ndarray, turn: int, turns: int):
    """n-grams of the texts to learn from, those of the turn's parts."""
    held, size = [], 0
    for flat, bounds in _learned(batches, modulus, held_out):
        words, columns = _numbered(flat, bounds, order)
        part = part_of(_place([words[c] for c in columns[-2:]], frequent), parts)
        if turns > 1:
            mine = np.flatnonzero(part % turns == turn)
            columns, part = [c[mine] for c in columns], part[mine]
        held.append((words, columns, part))
        size += len(part)
        if size >= 4_000_000:
            yield _rows(_shipped(held, parts))
            held, size = [], 0
    if held:
        yield _rows(_shipped(held, parts))


def _merged(batches, order: int, parts: int, uri: str, frequent: np.ndarray):
    """Merges the n-grams of this task's parts and writes their trees; a part at a time.

    They give those of all lower orders down to two tokens and the sums of all contexts here, as all n-grams of the
    same token before the last are in one part; of frequent ones only those with the same last token are, and
    partial sums go on. Yields single tokens, such sums, and counts of counts.
    """
    got: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            got.setdefault(part, []).append(data)
    for part in sorted(got):
        names, ids, count = _received(got.pop(part), order)
        if not len(count):
            continue
        if order == 1:
            raw = np.bincount(ids[0], count, len(names)).astype(np.int64)
            yield _rows(_by_part("w", names, [raw, raw], parts))
            continue
        begin = np.flatnonzero(names == BEGIN)
        tree = Grown(names, ids, count, int(begin[0]) if len(begin) else -1)
        write(f"{uri}/tree/{part:06d}.bin", [bundle(tree.arrays)])
        yield _rows([(f"n{k}", -1 - part, pack(seen)) for k, seen in tree.seen.items()])
        last = tree.raw > 0
        yield _rows(_by_part("w", names[last], [tree.followed[last], tree.raw[last]], parts))
        for k, sums in tree.sums.items():
            context = tree.contexts(k - 1)
            partial = _among(context[-1], frequent)
            yield _rows(_by_part(f"c{k}", chain(context)[partial], [s[partial] for s in sums], parts))


def _summed(batches, uri: str):
    """Merges single tokens and partial sums of contexts and writes their arrays; yields counts of counts and which files there are."""
    got: dict[tuple[str, int], list[bytes]] = {}
    for batch in batches:
        for kind, part, data in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if part < 0:
                yield _rows([(kind, part, data)])
            else:
                got.setdefault((kind, part), []).append(data)
    for kind, part in sorted(got):
        h, *sums = (np.concatenate(x) for x in zip(*[_loosened(d) for d in got.pop((kind, part))], strict=True))
        h, sums = _keyed(h, [s.astype(np.int64) for s in sums])
        write(f"{uri}/{kind}/{part:06d}.bin", [h, *[small(s) for s in sums]])
        yield _rows([(kind, -1 - part, pack(np.array([len(h), sums[-1].sum()], dtype=np.int64)))])
        if kind == "w":
            seen = np.bincount(np.minimum(sums[0], 5), minlength=6)[1:5]
            yield _rows([("n1", -1 - part, pack(np.array([*seen, sums[0].sum(), len(h)], dtype=np.int64)))])


def _by_part(kind: str, h: np.ndarray, sums: list[np.ndarray], parts: int) -> list[tuple[str, int, bytes]]:
    h, sums = _keyed(h, sums)
    cuts = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
    return [(kind, p, _squeezed(h[cuts[p] : cuts[p + 1]], *[s[cuts[p] : cuts[p + 1]] for s in sums])) for p in np.flatnonzero(np.diff(cuts)).tolist()]


def _keyed(h: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums by hash, sorted."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], [np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums]


def discounts(seen: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from how many n-grams have counts 1 to 4; each at least 0 and at most its count."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *[min(max(d, 0.0), k) for d, k in zip(raw, (1.0, 2.0, 3.0), strict=True)]])


@dataclass
class Model:
    """Where the files are: trees of contexts, w followed and occurring counts of tokens, c<k> sums of contexts of frequent tokens; and global counts.

    files: the parts of each that hold anything; seen: by order the n-grams of counts 1 to 4, their total, their number;
    frequent: the sorted hashes of the tokens whose n-grams are dealt out by the last token too.
    """

    uri: str
    order: int
    parts: int
    n_tokens: int
    n_types: int
    seen: dict[int, np.ndarray]
    files: dict[str, set[int]]
    frequent: np.ndarray

    def table(self, kind: str) -> Table:
        return Table(f"{self.uri}/{kind}", self.parts, self.files.get(kind, set()))


def train(docs: DataFrame, order: int = 2, modulus: int = 7, held_out: int = 2) -> Model:
    """Learns from all rows of ``docs`` whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``.

    A null text is an empty one, a null doc_id counts as empty text; repeated rows count as often as
    they are there. Without anything to learn from the model is uniform over one token. The texts are read once for
    each of ``TURNS`` groups of parts, so that only one group's n-grams are on their way at a time.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // TEXT_PER_PART))
    uri = shared.place(spark, "kneser-ney")
    with shared.without_shuffles(spark):
        frequent = np.zeros(0, np.uint64)
        if parts > 1 and order > 1:
            often = docs.mapInArrow(bounded(lambda b: _often(b, parts, modulus, held_out)), "token long, n long")
            top = often.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(2 * parts + 1).collect()
            total = sum(r.n for r in top if r.token is None)
            frequent = np.sort(np.array([r.token for r in top if r.token is not None and 2 * parts * r.n > total], np.int64).view(np.uint64))
        turns = min(TURNS, parts)
        kept = []
        for turn in range(turns):
            rows = docs.mapInArrow(bounded(lambda b, turn=turn: _counted(b, order, parts, modulus, held_out, frequent, turn, turns)), ROWS)
            rows = rows.repartitionById(-(-parts // turns), F.floor(F.col("part") / turns).cast("int")).mapInArrow(bounded(lambda b: _merged(b, order, parts, uri, frequent)), ROWS)
            kept.append(shared.keep(rows, "kneser-ney-sums"))
        rows = reduce(DataFrame.unionAll, kept).repartition(parts, "kind", "part").mapInArrow(bounded(lambda b: _summed(b, uri)), ROWS)
        collected = rows.where("part < 0").collect()  # a few numbers of each part
    stats: dict[str, np.ndarray] = {}
    files: dict[str, set[int]] = {}
    for kind, part, data in collected:
        a = unpack(data)[0].astype(np.int64)
        stats[kind] = stats[kind] + a if kind in stats else a
        files.setdefault(kind, set()).add(-1 - part)
    files["tree"] = files.get("n2", set())
    n_types, n_tokens = stats.get("w", (0, 0))
    seen = {k: stats.get(f"n{k}", np.zeros(6, np.int64)) for k in range(1, order + 1)}
    return Model(uri, order, parts, int(n_tokens), int(n_types), seen, files, frequent)


class Scorer:
    """Log10 probabilities of tokens by a model's mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.words = model.table("w")
        self.trees: dict[int, Tree] = {}
        self.contexts = {k: model.table(f"c{k}") for k in range(2, model.order + 1)}

    def found(self, words: np.ndarray, columns: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
        """By order from 2 up: the counts of n-grams, and the four sums of their contexts. See ``Tree.find``."""
        model, n = self.model, len(columns[0])
        out = {k: [np.zeros(n, np.int64) for _ in range(5)] for k in range(2, model.order + 1)}
        if not out:
            return out
        part = small(part_of(_place([words[c] for c in columns[-2:]], model.frequent), model.parts))
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(model.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            if p not in model.files["tree"]:
                continue
            if p not in self.trees:
                self.trees[p] = Tree(read(f"{model.uri}/tree/{p:06d}.bin")[0], model.order)
            mine = order[cuts[p] : cuts[p + 1]]
            for k, values in self.trees[p].find(words, [c[mine] for c in columns]).items():
                for o, v in zip(out[k], values, strict=True):
                    o[mine] = v
        partial = np.flatnonzero(_among(words[columns[-2]], model.frequent))
        if len(partial):
            for k, values in out.items():
                context = chain([words[c[partial]] for c in columns[-k:-1]])
                for o, v in zip(values[1:], _looked_up(self.contexts[k], context, 4), strict=True):
                    o[partial] = v
        return out

    def scored(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token of the texts the log10 probability after those before it, and how often it occurs in what was learned."""
        words, columns = _numbered(flat, bounds, self.model.order)
        followed, often = self.words.find(words, 2)
        often = often[columns[-1]]
        kinds, back = np.unique(packed([*columns[-2::-1], columns[-1]], len(words).bit_length()), return_inverse=True)
        row = np.empty(len(kinds), np.int64)
        row[back] = np.arange(len(back))
        columns = [c[row] for c in columns]
        return self.log10(words, columns, followed[columns[-1]])[back], often

    def log10(self, words: np.ndarray, columns: list[np.ndarray], followed: np.ndarray) -> np.ndarray:
        """Of each row's last token after the others; ``followed``: after how many different tokens it stands."""
        model = self.model
        p = np.full(len(columns[0]), 1.0 / (model.n_types + 1))
        found = self.found(words, columns)
        for k in range(1, model.order + 1):
            d = discounts(model.seen[k][:4])
            if k == 1:
                n1, n2 = model.seen[1][:2]
                count, total, n1, n2, n3 = (followed, *(np.full(len(p), x) for x in (model.seen[1][4], n1, n2, model.seen[1][5] - n1 - n2)))
            else:
                count, total, n1, n2, n3 = found.pop(k)
            of = np.maximum(total, 1)
            better = (count - d[np.minimum(count, 3)]) / of + (d[1] * n1 + d[2] * n2 + d[3] * n3) / of * p
            p = np.where(total > 0, better, p)
        return np.log10(p)


def _looked_up(table: Table, keys: np.ndarray, columns: int) -> list[np.ndarray]:
    distinct, where = np.unique(keys, return_inverse=True)
    return [v[where] for v in table.find(distinct, columns)]


def score(docs: DataFrame, model: Model, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    score: log10 probability of the whole text, its end included; base_score: that of add-one
    unigrams; n_known: tokens that occur in what the model learned from. A null or empty text is one
    end. Repeated rows give repeated rows, an empty table an empty one.
    """
    shared.ship(docs.sparkSession)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            ids = batch.column("doc_id")
            held = crc_remainder(ids.to_pylist(), modulus) == held_out
            raw, at = buffers(batch.column("text"))
            for first, end, part, offsets in slices(raw, at, 1 << 22):
                flat, bounds = tokens(Words(part, offsets))
                logs, count = scorer.scored(flat, bounds)
                base = np.log10((count + 1.0) / (model.n_tokens + model.n_types + 1.0))
                sizes = np.diff(bounds)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (logs, base, (count > 0).astype(np.int64))]
                cols = [ids.slice(first, end - first), held[first:end], sizes, sums[2], np.full(end - first, model.n_tokens), sums[1], sums[0], 10.0 ** np.minimum(-sums[0] / sizes, 300)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select("doc_id", "text").mapInArrow(bounded(run), kind)
