"""Iterators for code that runs inside a task over its own rows."""

from __future__ import annotations

import io
import itertools
import pickle
import zlib
from collections import deque
from collections.abc import Iterable, Iterator


def packets(items: Iterable, size: int) -> Iterator[tuple]:
    """Tuples of ``size`` items, the last one of what is left."""
    return itertools.batched(items, size)


def groups(items: Iterable, size: int, fill=None) -> Iterator[tuple]:
    """Tuples of ``size`` items; the last one is filled up."""
    for some in packets(items, size):
        yield some + (fill,) * (size - len(some))


class Peekable:
    """An iterator whose next items can be looked at, one further with each look, before they are taken."""

    def __init__(self, items: Iterable):
        self.rest, self.seen, self.looks = iter(items), deque(), 0

    def __iter__(self) -> Peekable:
        return self

    def __next__(self):
        self.looks = max(0, self.looks - 1)
        return self.seen.popleft() if self.seen else next(self.rest)

    def peek(self):
        """The item after those looked at so far; StopIteration beyond the last."""
        if self.looks == len(self.seen):
            self.seen.append(next(self.rest))
        self.looks += 1
        return self.seen[self.looks - 1]

    def reset_peek(self) -> None:
        """Looks begin at the next item again."""
        self.looks = 0


class CompressedQueue:
    """Items kept compressed in memory, read in their order as often as wanted."""

    def __init__(self, level: int = 4):
        self.level, self.blocks, self.waiting, self.size = level, [], io.BytesIO(), 0

    def put(self, item) -> None:
        pickle.dump(item, self.waiting)
        self.size += 1
        if self.waiting.tell() > 1 << 16:
            self._close()

    def put_all(self, items: Iterable, most: int | None = None) -> None:
        for item in itertools.islice(items, most):
            self.put(item)

    def _close(self) -> None:
        if self.waiting.tell():
            self.blocks.append(zlib.compress(self.waiting.getvalue(), self.level))
            self.waiting = io.BytesIO()

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator:
        self._close()
        for block in self.blocks:
            data = io.BytesIO(zlib.decompress(block))
            while data.tell() < len(data.getbuffer()):
                yield pickle.load(data)
