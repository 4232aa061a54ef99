"""Binary alignment files as k-mer loci, without a library.

A file is a row of gzip blocks. Each task takes whole files and reads them as a stream, block by block, so that memory
does not grow with a file; files are read in parallel. What is read goes the same way as SAM text.
"""

from __future__ import annotations

import gzip
import struct
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sam import COUNTS, aligned_kmers, counted

# The codes of bases and of CIGAR operations, and the sizes of the types of tags.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
MAGIC = b"BAM\x01"
#: k-mers that a task counts before it hands them on.
HELD = 200_000


def _take(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise EOFError("the file ends in the middle of a record")
    return data


def header(stream) -> tuple[list[str], list[tuple[str, int]]]:
    """The lines of the text header, and the references with their lengths."""
    if _take(stream, 4) != MAGIC:
        raise ValueError("no binary alignment file")
    (size,) = struct.unpack("<i", _take(stream, 4))
    lines = _take(stream, size).rstrip(b"\0").decode().splitlines()
    (n,) = struct.unpack("<i", _take(stream, 4))
    references = []
    for _ in range(n):
        (length,) = struct.unpack("<i", _take(stream, 4))
        name = _take(stream, length)[:-1].decode()
        references.append((name, struct.unpack("<i", _take(stream, 4))[0]))
    return lines, references


def read_group(tags: bytes) -> str | None:
    """The text of the tag RG."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            end = tags.index(b"\0", at)
            if name == b"RG":
                return tags[at:end].decode()
            at = end + 1
        elif kind == "B":
            (n,) = struct.unpack_from("<i", tags, at + 1)
            at += 5 + n * TAG_SIZES[chr(tags[at])]
        else:
            at += TAG_SIZES[kind]
    return None


def reads(stream) -> Iterator[tuple[int, int, int, str, str, str | None]]:
    """(reference number, place from 1, flag, CIGAR, bases, read group) of each record after the header."""
    while head := stream.read(4):
        record = _take(stream, struct.unpack("<i", head)[0])
        ref, pos, name, _, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", record)
        at = 32 + name
        cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", record, at))
        at += 4 * n_cigar
        packed = record[at : at + (n_seq + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
        yield ref, pos + 1, flag, cigar, seq, read_group(record[at + len(packed) + n_seq :])


def read_kmers(spark: SparkSession, paths: list[str], k: int, step: int = 1, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """ref, pos, sample, kmer, n of all files together, as ``sam.read_kmers`` gives them; paths are readable by every executor."""

    def run(batches):
        from pyarrow import fs

        wanted = None if regions is None else {r[0] for r in regions}
        for pdf in batches:
            for path in pdf["path"]:
                store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                with store.open_input_stream(inside, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    lines, references = header(stream)
                    groups = {}
                    for line in lines:
                        if line.startswith("@RG"):
                            items = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
                            groups[items["ID"]] = items.get("SM")
                    count: Counter = Counter()
                    for ref, pos, flag, cigar, seq, group in reads(stream):
                        if ref < 0 or flag & 4 or wanted is not None and references[ref][0] not in wanted:
                            continue
                        count.update((references[ref][0], at, groups.get(group), kmer) for at, kmer in aligned_kmers(pos, cigar, seq, k))
                        if len(count) >= HELD:
                            yield _rows(count)
                            count = Counter()
                    yield _rows(count)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    kmers = counted(files.mapInPandas(run, COUNTS), step, regions)
    return kmers.groupBy("ref", "pos", "sample", "kmer").agg(F.sum("n").alias("n"))


def _rows(count: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*key, n) for key, n in count.items()], columns=["ref", "pos", "sample", "kmer", "n"])


def encode(lines: list[str]) -> bytes:
    """The lines of a small SAM text as a binary file, for fixtures: RG is the only tag that is kept."""
    heads = [x for x in lines if x.startswith("@")]
    references = [dict(y.split(":", 1) for y in x.split("\t")[1:]) for x in heads if x.startswith("@SQ")]
    names = [r["SN"] for r in references]
    text = "".join(f"{x}\n" for x in heads).encode()
    out = [MAGIC, struct.pack("<i", len(text)), text, struct.pack("<i", len(names))]
    for r in references:
        out.append(struct.pack("<i", len(r["SN"]) + 1) + r["SN"].encode() + b"\0" + struct.pack("<i", int(r["LN"])))
    import re

    for line in lines:
        if line.startswith("@"):
            continue
        f = line.split("\t")
        cigar = [(int(n) << 4) | OPERATIONS.index(op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", f[5])]
        codes = [BASES.index(b) for b in f[9]]
        packed = bytes((a << 4) | b for a, b in zip(codes[::2], [*codes[1::2], 0][: (len(codes) + 1) // 2], strict=True))
        name = f[0].encode() + b"\0"
        ref = names.index(f[2]) if f[2] in names else -1
        body = struct.pack("<iiBBHHHiiii", ref, int(f[3]) - 1, len(name), int(f[4]), 0, len(cigar), int(f[1]), len(codes), -1, -1, 0)
        tags = b"".join(b"RGZ" + x[5:].encode() + b"\0" for x in f[11:] if x.startswith("RG:Z:"))
        body += name + struct.pack(f"<{len(cigar)}I", *cigar) + packed + b"\xff" * len(codes) + tags
        out.append(struct.pack("<i", len(body)) + body)
    data = b"".join(out)
    blocks = [gzip.compress(data[i : i + 60_000]) for i in range(0, len(data), 60_000)]  # each block is a gzip member
    return b"".join(blocks)
