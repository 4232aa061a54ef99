"""Sorted hash arrays as plain files in the shared folder, written by one task each and memory-mapped by workers."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid

import numpy as np
from pyarrow import fs

from .bytewise import U


def _at(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; whole numbers take as few bytes as their largest needs."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        if a.dtype.kind == "u" and a.dtype != np.uint64 or a.dtype.kind == "i":
            a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        out += [struct.pack("<4sQ", a.dtype.str[1:].encode().ljust(4), len(a)), a.tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<4sQ", data, at)
        at += 12
        dtype = np.dtype("<" + kind.decode().strip())
        out.append(np.frombuffer(data, dtype=dtype, count=size, offset=at))
        at += size * dtype.itemsize
    return out


def write(uri: str, arrays: list[np.ndarray]) -> None:
    """One file with arrays of equal length, each at a multiple of 8 bytes.

    A repeated or speculative task writes the same bytes under a name of its own; the first to end gives the file its name.
    """
    store, path = _at(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(struct.pack("<QQ", len(arrays), len(arrays[0])))
        for a in arrays:
            out.write(a.dtype.str[1:].encode().ljust(8))
        for a in arrays:
            data = a.tobytes()
            out.write(data + bytes(-len(data) % 8))
    try:
        store.move(part, path)
    except OSError:  # some stores don't replace a file: it is there from another attempt
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(part)


def read(uri: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped: in place where the folder is mounted, else from a copy that has no name any more."""
    store, path = _at(uri)
    if not isinstance(store, fs.LocalFileSystem):
        handle, copy = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as source:
            while data := source.read(1 << 24):
                out.write(data)
        mapped = np.memmap(copy, dtype=np.uint8, mode="r")
        os.unlink(copy)
    else:
        mapped = np.memmap(path, dtype=np.uint8, mode="r")
    k, n = struct.unpack("<QQ", mapped[:16].tobytes())
    at, out = 16 + 8 * k, []
    for i in range(k):
        dtype = np.dtype("<" + mapped[16 + 8 * i : 24 + 8 * i].tobytes().decode().strip())
        size = n * dtype.itemsize
        out.append(mapped[at : at + size].view(dtype))
        at += size + -size % 8
    return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: equal ranges of the hashes, in order."""
    return (((hashes >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


class Table:
    """Sorted hashes with columns, one file per range of hashes; ``filled`` are the ranges that have one."""

    def __init__(self, uri: str, parts: int, filled: set[int]):
        self.uri, self.parts, self.filled = uri, parts, filled
        self.open: dict[int, list[np.ndarray]] = {}

    def rows(self, part: int) -> list[np.ndarray]:
        if part not in self.open:
            self.open[part] = read(f"{self.uri}/{part:06d}.bin")
        return self.open[part]

    def find(self, keys: np.ndarray, columns: int, place: np.ndarray | None = None) -> list[np.ndarray]:
        """The columns of each of the sorted keys; 0 where it is absent. ``place``: hashes that parts go by, if not the keys."""
        parts = part_of(keys if place is None else place, self.parts)
        order = np.argsort(parts, kind="stable")
        cuts = np.searchsorted(parts[order], np.arange(self.parts + 1))
        out = [np.zeros(len(keys), dtype=np.int64) for _ in range(columns)]
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            if p not in self.filled:
                continue
            mine = order[cuts[p] : cuts[p + 1]]
            hashes, *values = self.rows(p)
            at = np.searchsorted(hashes, keys[mine])
            at[at == len(hashes)] = 0
            hit = hashes[at] == keys[mine]
            for o, v in zip(out, values, strict=True):
                o[mine] = np.where(hit, v[at], 0)
        return out


def sink(uri: str):
    """A new file, open for bytes."""
    store, path = _at(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


class Runs:
    """Runs of 64-bit numbers in the files of a folder, read one by one; those of the last ``room`` numbers are remembered."""

    def __init__(self, uri: str, room: int = 4 << 20):
        self.store, self.path = _at(uri)
        self.room, self.size = room, 0
        self.open: dict[int, object] = {}
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def get(self, file: int, at: int, n: int) -> np.ndarray:
        """The n numbers from number ``at`` of a file on."""
        if (run := self.held.get((file, at))) is None:
            if self.size + n > self.room:
                self.held, self.size = {}, 0
            if file not in self.open:
                if len(self.open) >= 64:
                    self.close()
                self.open[file] = self.store.open_input_file(f"{self.path}/{file}.bin")
            run = np.frombuffer(self.open[file].read_at(8 * n, 8 * at), dtype="<u8")
            self.held[file, at] = run
            self.size += n
        return run

    def close(self) -> None:
        for file in self.open.values():
            file.close()
        self.open = {}
