"""Contexts of n-grams as a tree with what follows each of them, in few bytes, searched in place.

A context's last token is at the first level, the token before it below that, and so on. Tokens are numbered
by the sorted list of their hashes. Children and followers of a context are runs of numbers in order; where
runs start takes about a byte each, counts take one, and sums of contexts a code; what does not fit stands in lists
beside. Nothing is rounded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

Get = Callable[[np.ndarray], np.ndarray]


def bundle(arrays: dict[str, np.ndarray]) -> np.ndarray:
    """Named arrays of any lengths as bytes, each at a multiple of 8."""
    head = struct.pack("<Q", len(arrays)) + b"".join(struct.pack("<8s8sQ", k.encode(), a.dtype.str[1:].encode(), len(a)) for k, a in arrays.items())
    return np.frombuffer(head + b"".join((d := a.tobytes()) + bytes(-len(d) % 8) for a in arrays.values()), np.uint8)


def opened(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a bundle, in place."""
    data = np.asarray(data)
    (n,), out = struct.unpack("<Q", data[:8].tobytes()), {}
    at = 8 + 24 * n
    for i in range(n):
        name, kind, size = struct.unpack("<8s8sQ", data[8 + 24 * i : 32 + 24 * i].tobytes())
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        out[name.rstrip(b"\0").decode()] = data[at : at + size * dtype.itemsize].view(dtype)
        at += size * dtype.itemsize + -size * dtype.itemsize % 8
    return out


def small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def put_numbers(out: dict, name: str, a: np.ndarray) -> None:
    """Whole numbers in as many bytes as the largest needs; three bytes are two arrays."""
    if len(a) and 1 << 16 <= int(a.max()) < 1 << 24:
        out[name], out[name + "+"] = (a & 0xFFFF).astype(np.uint16), (a >> 16).astype(np.uint8)
    else:
        out[name] = small(a)


def numbers(arrays: dict, name: str) -> Get:
    low, high = arrays[name], arrays.get(name + "+")
    if high is None:
        return lambda i: low[i].astype(np.int64)
    return lambda i: low[i].astype(np.int64) | high[i].astype(np.int64) << 16


def put_rising(out: dict, name: str, a: np.ndarray) -> None:
    """Numbers that never fall: their last bytes, and where each value of the rest begins."""
    out[name] = (a & 0xFF).astype(np.uint8)
    out[name + "^"] = small(np.searchsorted(a >> 8, np.arange((int(a[-1]) >> 8) + 1)))


def rising(arrays: dict, name: str) -> Get:
    low, first = arrays[name], arrays[name + "^"].astype(np.int64)
    return lambda i: (np.searchsorted(first, i, "right") - 1) << 8 | low[i].astype(np.int64)


def put_coded(out: dict, name: str, rows: list[np.ndarray]) -> None:
    """Rows of numbers by a code of one byte: the 255 most frequent in a table, others in a list with their places."""
    fits = np.max(rows, axis=0) < 1 << 64 // len(rows) - 1
    key = np.zeros(len(rows[0]), np.int64)
    for r in rows:
        key = key << 64 // len(rows) - 1 | r
    kinds, where, often = np.unique(key[fits], return_inverse=True, return_counts=True)
    best = np.argsort(-often, kind="stable")[:255]
    code_of = np.full(len(kinds), 255, np.uint8)
    code_of[best] = np.arange(len(best))
    codes = np.full(len(key), 255, np.uint8)
    codes[fits] = code_of[where]
    example = np.flatnonzero(fits)[np.unique(where, return_index=True)[1]][best] if len(kinds) else np.zeros(0, np.int64)
    others = np.flatnonzero(codes == 255)
    out[name], out[name + "@"] = codes, small(others)
    for i, r in enumerate(rows):
        out[f"{name}#{i}"], out[f"{name}*{i}"] = small(r[example]), small(r[others])


def coded(arrays: dict, name: str, columns: int) -> Callable[[np.ndarray], list[np.ndarray]]:
    codes, others = arrays[name], arrays[name + "@"]

    def get(i: np.ndarray) -> list[np.ndarray]:
        code = codes[i]
        rare = np.flatnonzero(code == 255)
        place = np.searchsorted(others, i[rare].astype(others.dtype))
        out = []
        for c in range(columns):
            table = np.zeros(256, np.int64)
            table[: len(arrays[f"{name}#{c}"])] = arrays[f"{name}#{c}"]
            values = table[code]
            values[rare] = arrays[f"{name}*{c}"][place]
            out.append(values)
        return out

    return get


def within(get: Get, low: np.ndarray, high: np.ndarray, want: np.ndarray, top: int) -> np.ndarray:
    """For each row the place of ``want`` in the ascending numbers from low to high, -1 where it is not there.

    Numbers below ``top`` are ranks of hashes and lie evenly: long runs are cut first around where ``want`` should be.
    """
    at = low.copy()
    open_ = np.flatnonzero(high - low > 1)
    lo, hi, w = low[open_], high[open_], want[open_]
    long = np.flatnonzero(hi - lo > 256)
    if len(long):
        first, end, w_ = lo[long], hi[long], w[long]
        middle, reach = first + np.maximum(w_, 0) * (end - first) // top, np.sqrt(end - first).astype(np.int64)
        for cut in (middle - reach, middle + reach):
            cut = np.clip(cut, first, end - 1)
            up = get(cut) <= w_
            first, end = np.where(up, cut, first), np.where(up, end, np.maximum(cut, first + 1))
        lo[long], hi[long] = first, end
    while len(open_):
        middle = (lo + hi) >> 1
        up = get(middle) <= w
        lo, hi = np.where(up, middle, lo), np.where(up, hi, middle)
        more = hi - lo > 1
        if np.count_nonzero(more) < 0.8 * len(more):  # the others stay where they are in further steps
            at[open_] = lo
            open_, lo, hi, w = open_[more], lo[more], hi[more], w[more]
    there = np.flatnonzero(low < high)
    there = there[get(at[there]) == want[there]]
    out = np.full(len(low), -1, np.int64)
    out[there] = at[there]
    return out


class Tree:
    """The contexts of a part, read from a bundle of ``Grown``."""

    def __init__(self, data: np.ndarray, order: int):
        arrays = opened(data)
        self.names, self.order = arrays["names"], order
        self.last = arrays["last"].astype(np.int64)
        self.tokens = {d: numbers(arrays, f"t{d}") for d in range(2, order)}
        self.children = {d: rising(arrays, f"d{d}") for d in range(2, order)}
        self.starts = {k: rising(arrays, f"s{k}") for k in range(2, order + 1)}
        self.words = {k: numbers(arrays, f"w{k}") for k in range(2, order + 1)}
        self.counts = {k: coded(arrays, f"c{k}", 1) for k in range(2, order + 1)}
        self.sums = {k: coded(arrays, f"z{k}", 4) for k in range(2, order + 1)}

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, hashes)
        at[at == len(self.names)] = 0
        return np.where(self.names[at] == hashes, at, -1)

    def find(self, words: np.ndarray, columns: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
        """By order from 2 up, of the n-gram in the last columns: its count, and the four sums of its context; 0 where absent.

        columns: numbers into the sorted hashes ``words``. The rows differ and are in order of the token before the last, of
        that before it and so on, then of the last: so each context is looked up once, and neighbours are near each other.
        """
        needed, out = np.zeros(len(words), dtype=bool), {}
        for c in columns:
            needed[c] = True
        some, to = np.flatnonzero(needed), np.full(len(words), -1, np.int64)
        to[some] = self.numbered(words[some])
        new, node, group = np.zeros(len(columns[0]), dtype=bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new[0] = True
        for k in range(2, self.order + 1):
            column = columns[-k]
            new[1:] |= column[1:] != column[:-1]
            heads = np.flatnonzero(new)
            want = to[column[heads]]
            if k == 2:
                node = np.searchsorted(self.last, want)
                node[node == len(self.last)] = 0
                node = np.where(self.last[node] == want, node, -1)
            else:
                above = node[group[heads]]
                there = np.flatnonzero(above >= 0)
                at, node = above[there], np.full(len(heads), -1, np.int64)
                node[there] = within(self.tokens[k - 1], self.children[k - 1](at), self.children[k - 1](at + 1), want[there], len(self.names))
            group = np.cumsum(new) - 1
            there = np.flatnonzero(node >= 0)
            sums = np.zeros((4, len(heads)), np.int64)
            sums[:, there] = self.sums[k](node[there])
            if k == self.order:
                context, last, where = group, columns[-1], slice(None)
            else:
                pairs, where = np.unique(group * len(words) + columns[-1], return_inverse=True)
                context, last = np.divmod(pairs, len(words))
            there = np.flatnonzero(node[context] >= 0)
            at = node[context[there]]
            found = within(self.words[k], self.starts[k](at), self.starts[k](at + 1), to[last[there]], len(self.names))
            hit, counts = np.flatnonzero(found >= 0), np.zeros(len(last), np.int64)
            counts[there[hit]] = self.counts[k](found[hit])[0]
            out[k] = [counts[where], *sums[:, group]]
        return out


def packed(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Rows of numbers of so many bits as one number each, in the order of the rows."""
    key, used = columns[0], bits
    for c in columns[1:]:
        if used + bits > 63:
            kinds, key = np.unique(key, return_inverse=True)
            used = len(kinds).bit_length()
        key, used = key << bits | c, used + bits
    return key


def grouped(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a row of each, and sums of the values."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], order[first], np.add.reduceat(values[order], first)


class Grown:
    """The tree of n-grams with counts, of order 2 at least and not without rows.

    ids: the columns of numbers into the sorted hashes ``names``; begin: the number of the begin, or -1.
    arrays: for ``bundle``; by order k counts of counts ``seen`` and the contexts' sums ``sums``;
    raw: occurrences of each name as last token, followed: after how many different tokens it stands.
    """

    def __init__(self, names: np.ndarray, ids: list[np.ndarray], count: np.ndarray, begin: int):
        order, bits = len(ids), len(names).bit_length()
        self.names, self.order = names, order
        self.parents: dict[int, np.ndarray] = {}
        self.tokens: dict[int, np.ndarray] = {}
        self.seen: dict[int, np.ndarray] = {}
        self.sums: dict[int, list[np.ndarray]] = {}
        out = self.arrays = {"names": names}
        by = np.argsort(packed([*ids[-2::-1], ids[-1]], bits))
        ids, count = [c[by] for c in ids], count[by]
        new, nodes = np.zeros(len(count), dtype=bool), {}
        new[0] = True
        for d in range(1, order):
            column = ids[-1 - d]
            new[1:] |= column[1:] != column[:-1]
            heads = np.flatnonzero(new)
            nodes[d], self.tokens[d] = np.cumsum(new) - 1, column[heads]
            if d == 1:
                out["last"] = small(column[heads])
                continue
            self.parents[d] = nodes[d - 1][heads]
            put_rising(out, f"d{d}", np.searchsorted(self.parents[d], np.arange(len(self.tokens[d - 1]) + 1)))
            put_numbers(out, f"t{d}", self.tokens[d])
        for k in range(order, 1, -1):
            key, picked, count = grouped(nodes[k - 1] << bits | ids[-1], count)
            nodes, ids = {d: nodes[d][picked] for d in range(1, k)}, [c[picked] for c in ids]
            starts = np.searchsorted(key >> bits, np.arange(len(self.tokens[k - 1]) + 1))
            put_rising(out, f"s{k}", starts)
            put_numbers(out, f"w{k}", ids[-1])
            put_coded(out, f"c{k}", [count])
            kinds = [count, *[(np.minimum(count, 3) == j).astype(np.int64) for j in (1, 2, 3)]]
            self.sums[k] = [np.add.reduceat(x, starts[:-1]) for x in kinds]
            put_coded(out, f"z{k}", self.sums[k])
            self.seen[k] = np.array([*np.bincount(np.minimum(count, 5), minlength=6)[1:5], count.sum(), len(count)], np.int64)
            if k == order:
                self.raw = np.bincount(ids[-1], count, len(names)).astype(np.int64)
            # Only begins come before a begin: what starts with one keeps its count, not that of its left neighbours.
            count = np.where(ids[1 - k] == begin, count, 1) if k > 2 else np.ones_like(count)
        self.followed = np.bincount(ids[-1], count, len(names)).astype(np.int64)

    def contexts(self, depth: int) -> list[np.ndarray]:
        """Columns of hashes of the contexts of so many tokens, in the order of ``sums[depth + 1]``."""
        at, out = np.arange(len(self.tokens[depth])), []
        for d in range(depth, 0, -1):
            out.append(self.names[self.tokens[d][at]])
            at = self.parents[d][at] if d > 1 else at
        return out
