"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs, ordered by piece score and then from left to
right, and merges until no pair is a piece. No piece of the vocabularies that it accepts has a
word-boundary sign after another character, so merges never cross the start of a word: texts are
cut there, and each worker keeps the ids of words it has met. Texts are encoded in Arrow batches,
and every text's ids and decoded text are compared with those of the sentencepiece library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import shared
from .bytewise import bounded, buffers

MARK = "▁"
#: Words that a worker remembers, each of at most LONG characters; when full only those of the texts at hand stay.
REMEMBERED = 300_000
#: Words of more characters have an agenda of their own and are not remembered.
LONG = 48
#: The order of a pair that forms no piece, and the symbol that was merged into the one before it.
NEVER = 1 << 30
GONE = -(1 << 40)


class Codec:
    """Encoding and decoding with the vocabulary of one model file."""

    def __init__(self, model: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = [None] * len(self.names)
        self.byte_ids = [0] * 256
        self.rank: dict[str, tuple[float, int]] = {}
        for i, name in enumerate(self.names):
            if sp.is_byte(i):
                value = int(name[3:5], 16)
                self.byte[i], self.byte_ids[value] = value, i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[name] = (-sp.get_score(i), i)
        if any(MARK in name.lstrip(MARK) for name in self.rank):
            raise ValueError("a piece of this vocabulary crosses the start of a word")
        self._pairs()
        self.bos, self.eos, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self._bytes()
        self.known: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of a run of characters, by the agenda."""
        rank = self.rank
        parts = list(word)
        n = len(parts)
        if n > 1:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            agenda = []
            for i in range(n - 1):
                pair = parts[i] + parts[i + 1]
                if (found := rank.get(pair)) is not None:
                    agenda.append((found[0], i, pair))
            heapq.heapify(agenda)
            while agenda:
                _, i, pair = heapq.heappop(agenda)
                if parts[i] is None:
                    continue
                j = right[i]
                if j >= n or parts[i] + parts[j] != pair:
                    continue
                parts[i], parts[j] = pair, None
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    after = pair + parts[k]
                    if (found := rank.get(after)) is not None:
                        heapq.heappush(agenda, (found[0], i, after))
                h = left[i]
                if h >= 0:
                    before = parts[h] + pair
                    if (found := rank.get(before)) is not None:
                        heapq.heappush(agenda, (found[0], h, before))
        ids = []
        for part in parts:
            if part is None:
                continue
            if (found := rank.get(part)) is not None:
                ids.append(found[1])
            else:
                ids.extend(self.byte_ids[b] for b in part.encode())
        return ids

    def _pairs(self) -> None:
        """For the agendas of many words at once: a hash table of the pairs of pieces that form a piece, with its order and id."""
        found = []
        for name, (order, i) in self.rank.items():
            for k in range(1, len(name)):
                left, right = self.rank.get(name[:k]), self.rank.get(name[k:])
                if left and right:
                    found.append((left[1] << 32 | right[1], order, i))
        keys = np.array([x[0] for x in found] or [-2], dtype=np.int64)
        orders = np.unique([x[1] for x in found] or [0.0], return_inverse=True)[1]
        ids = np.array([x[2] for x in found] or [0], dtype=np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.pair_order, self.pair_ids = np.full(len(self.keys), NEVER), np.zeros(len(self.keys), dtype=np.int64)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):  # into the slot of its hash, or the next that is free
            free = rest[self.keys[at[rest]] == -1]
            self.keys[at[free]] = keys[free]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
        self.pair_order[at], self.pair_ids[at] = orders, ids
        self.characters = np.full(0x110000, -1, dtype=np.int64)
        for name, (_, i) in self.rank.items():
            if len(name) == 1:
                self.characters[ord(name)] = i
        if any(self.characters[ord(c)] < 0 for name in self.rank for c in name):
            raise ValueError("a piece of this vocabulary has a character that is no piece")

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and id of the pieces that pairs form; an order of NEVER where they form none."""
        key = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)  # -1 meets an empty slot
        at = self._slot(key)
        got = self.keys[at]
        rest = np.flatnonzero((got != key) & (got != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            got = self.keys[at[rest]]
            rest = rest[(got != key[rest]) & (got != -1)]
        return self.pair_order[at], self.pair_ids[at]

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Ids of many words as packed 32-bit integers; a space stands for the mark.

        In each round every word takes the best pair of its agenda, the leftmost of equals. Symbols are
        linked to their neighbours, so a round touches one pair of each word; words that are done leave
        when they are half of all.
        """
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym = self.characters[np.where(points == 32, ord(MARK), points)]
        final = np.where(sym < 0, -1 - points.astype(np.int64), sym)  # no piece: it stays alone and becomes its bytes
        begin = np.cumsum(size) - size
        word = np.flatnonzero((size > 1) & (size <= LONG))
        sym, (start, width) = final[_spread(begin[word], size[word])], _packed_runs(size[word])
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[start + width - 1], before[start] = -1, -1
        key, made = np.full(n, NEVER << 32), np.zeros(n, dtype=np.int64)
        if n > 1:
            order, made[:-1] = self._look(sym[:-1], sym[1:])
            key[:-1] = order << 32
            key[start + width - 1] = NEVER << 32
            key |= np.arange(n)
        while len(word):  # key: order and place of the pair that begins at each symbol
            best = np.minimum.reduceat(key, start)
            going = best >> 32 < NEVER
            if 2 * np.count_nonzero(going) <= len(word):
                done = ~going
                final[_spread(begin[word[done]], width[done])] = sym[_spread(start[done], width[done])]
                stay = _spread(start[going], width[going])
                moved, (fresh, width) = start[going], _packed_runs(width[going])
                shift = np.repeat(moved - fresh, width)
                word, start = word[going], fresh
                sym, made = sym[stay], made[stay]
                after, before = (np.where(x[stay] < 0, -1, x[stay] - shift) for x in (after, before))
                key = key[stay] - shift  # the place is the lower half
                at = (best[going] & 0xFFFFFFFF) - (moved - fresh)
            else:
                at = best[going] & 0xFFFFFFFF
            if not len(at):
                break
            gone = after[at]
            right, left = after[gone], before[at]
            sym[at], after[at] = made[at], right
            sym[gone] = GONE
            key[gone], key[at] = NEVER << 32 | gone, NEVER << 32 | at
            follows, leads = right >= 0, left >= 0
            before[right[follows]] = at[follows]
            one = np.concatenate([at[follows], left[leads]])
            order, made[one] = self._look(sym[one], np.concatenate([sym[right[follows]], sym[at[leads]]]))
            key[one] = order << 32 | one
        stays = final != GONE
        cuts = np.concatenate([[0], np.cumsum(stays)])[np.append(begin, len(final))].tolist()
        left = final[stays]
        raw = left.astype("<u4").tobytes()
        out = [raw[4 * b : 4 * e] for b, e in zip(cuts[:-1], cuts[1:], strict=True)]
        odd = np.flatnonzero(left < 0)
        for w in np.unique(np.searchsorted(cuts, odd, "right") - 1).tolist():
            some = left[cuts[w] : cuts[w + 1]].tolist()
            out[w] = np.array([i for x in some for i in ([x] if x >= 0 else [self.byte_ids[b] for b in chr(-1 - x).encode()])], dtype="<u4").tobytes()
        for w in np.flatnonzero(size > LONG).tolist():
            out[w] = np.array(self.merge(words[w].replace(" ", MARK)), dtype="<u4").tobytes()
        return out

    def _bytes(self) -> None:
        """For decoding: the bytes of every piece in one array, and whether a piece begins with a word's mark."""
        sp = self.library
        pieces, self.leads, self.raw_byte = [], np.zeros(len(self.names), dtype=np.int64), np.zeros(len(self.names), dtype=np.int64)
        for i, name in enumerate(self.names):
            if self.byte[i] is not None:
                pieces.append(bytes([self.byte[i]]))
                self.raw_byte[i] = 1
            elif sp.is_control(i):
                pieces.append(b"")
            else:
                name = " ⁇ " if i == self.unknown else name
                self.leads[i] = name[:1] == MARK
                pieces.append(name.replace(MARK, " ").encode())
        self.piece_size = np.array([len(x) for x in pieces], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    @staticmethod
    def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts, and the offsets of the texts among them.

        A word begins at a run of spaces, which belongs to it; each text that isn't empty has a space before it.
        """
        raw, at = buffers(pc.replace_substring(texts.cast(pa.large_string()), MARK, " "))
        some = np.diff(at) > 0
        padded = np.insert(raw, at[:-1][some], np.uint8(32))
        begins = at + np.concatenate([[0], np.cumsum(some)])
        space = padded == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[begins[:-1][some]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(padded)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(padded))
        return found, np.searchsorted(starts, begins)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, begin and end included, and the offsets of the texts; null is empty."""
        words, bounds = self.words(texts)
        met = words.dictionary_encode()
        names, which = met.dictionary.to_numpy(zero_copy_only=False).tolist(), met.indices.to_numpy()
        known = self.known
        new = [w for w in names if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {w: known[w] for w in names if w in known}
        known.update(zip(new, self.merge_many(new), strict=True))
        packed = [known[w] for w in names]
        for w in new:
            if len(w) > LONG:
                del known[w]
        flat = np.frombuffer(b"".join(packed), dtype="<u4")
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) >> 2
        inner = flat[_spread((np.cumsum(size) - size)[which], size[which])]
        ends = np.concatenate([[0], np.cumsum(size[which])])[bounds]
        ends += 2 * np.arange(len(ends))
        out = np.empty(len(inner) + 2 * len(texts), dtype="<u4")
        edge = np.zeros(len(out), dtype=bool)
        edge[ends[:-1]] = edge[ends[1:] - 1] = True
        out[ends[:-1]], out[ends[1:] - 1] = self.bos, self.eos
        out[~edge] = inner
        return out, ends

    def encode(self, text: str) -> list[int]:
        return self.encode_many(pa.array([text], pa.large_string()))[0].tolist()

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of ids in UTF-8; bytes that are not UTF-8 become replacement characters, one each."""
        start, size = self.piece_start[ids], self.piece_size[ids]
        shown = np.append(np.flatnonzero(size > 0), len(ids))
        first = shown[np.searchsorted(shown, bounds[:-1])]
        first = first[first < bounds[1:]]
        start[first] += self.leads[ids[first]]
        size[first] -= self.leads[ids[first]]
        raw = self.blob[_spread(start, size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])
        ends = at[bounds].tolist()
        odd = np.diff(np.concatenate([[0], np.cumsum(self.raw_byte[ids])])[bounds]) > 0
        out = [raw[b:e] for b, e in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.flatnonzero(odd).tolist():  # bytes on both sides of a begin or end are not one character
            cuts = np.unique(at[bounds[i] : bounds[i + 1] + 1][np.append(size[bounds[i] : bounds[i + 1]] == 0, True)]).tolist()
            runs = (raw[b:e] for b, e in zip([ends[i], *cuts], cuts, strict=False))
            out[i] = "".join(x.decode(errors="byte-by-byte") for x in runs).encode()
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        return self.decode_many(ids, np.array([0, len(ids)]))[0].decode()

    def agreement(self, ids: np.ndarray, bounds: np.ndarray, decoded: list[bytes], texts: list[str]) -> np.ndarray:
        """Whether ids and decoded text of each text are those of the sentencepiece library."""
        theirs = self.library.encode(texts, num_threads=1, add_bos=True, add_eos=True)
        size = np.fromiter(map(len, theirs), dtype=np.int64, count=len(theirs))
        good = size == np.diff(bounds)
        flat = np.fromiter(itertools.chain.from_iterable(theirs), dtype=np.uint32, count=int(size.sum()))
        mine = ids if good.all() else ids[np.repeat(good, np.diff(bounds))]
        flat = flat if good.all() else flat[np.repeat(good, size)]
        wrong = np.concatenate([[0], np.cumsum(mine != flat)])
        at = np.concatenate([[0], np.cumsum(size[good])])
        good[good] = wrong[at[1:]] == wrong[at[:-1]]
        back = self.library.decode(theirs, num_threads=1)
        return good & np.fromiter((a == b.encode() for a, b in zip(decoded, back, strict=True)), dtype=bool, count=len(texts))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then those of the next."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _packed_runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of runs of such sizes that lie one after the other, and the sizes."""
    return np.cumsum(sizes) - sizes, sizes


codecs.register_error("byte-by-byte", lambda e: ("\ufffd", e.start + 1))


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


#: Bytes of text that are encoded and checked together.
AT_ONCE = 1 << 20


def encode(docs: DataFrame, model: str, columns: tuple[str, ...] = ("doc_id",), keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Ids and decoded text of every text of ``docs``, whole; ``model`` is a path on every machine.

    Columns: ``columns`` of docs, n_tokens (begin and end ids counted), ids (array, if ``keep_ids``),
    decoded (if ``keep_text``), ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256, library_agrees: ids and decoded text are those of the sentencepiece library.
    A null text counts as empty: two ids. Repeated rows give repeated rows, an empty table an empty one.
    """
    shared.ship(docs.sparkSession)
    source = docs.select(*columns, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema]
    fields += ["n_tokens long"] + ["ids array<int>"] * keep_ids + ["decoded string"] * keep_text
    fields += ["ids_sha256 string", "decoded_sha256 string", "library_agrees boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            _, at = buffers(batch.column("text"))
            first = 0
            while first < len(batch):
                end = max(first + 1, int(np.searchsorted(at, at[first] + AT_ONCE, "right")) - 1)
                yield some(own, batch.slice(first, end - first))
                first = end

    def some(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").fill_null("")
        ids, bounds = own.encode_many(texts)
        decoded = own.decode_many(ids, bounds)
        arrays = [batch.column(c) for c in columns] + [pa.array(np.diff(bounds))]
        if keep_ids:
            arrays.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
        if keep_text:
            arrays.append(pa.array(decoded, pa.binary()).cast(pa.string()))
        cuts = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        arrays += [pa.array([hashlib.sha256(ids[b:e]).hexdigest() for b, e in cuts]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
        arrays.append(pa.array(own.agreement(ids, bounds, decoded, texts.to_pylist())))
        names = [*columns, "n_tokens", *["ids"] * keep_ids, *["decoded"] * keep_text, "ids_sha256", "decoded_sha256", "library_agrees"]
        return pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(bounded(run), ", ".join(fields))
