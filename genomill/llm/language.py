"""Language identification of whole texts, mixed ones included.

Each word is scored for each language by byte n-grams. The scripts of its letters narrow the
candidates to the languages that were written in them in training. A Viterbi pass over the words,
with a penalty for each switch of language, labels spans; the text's language is the one whose
spans hold most of its letters' bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .bytewise import SPACE, Words, bounded, buffers, slices

UNKNOWN = "und"
GRAM = 4
BUCKETS_LOG2 = 16
#: Natural-log units that a change of language costs.
SWITCH = 12.0
#: A language is a candidate in a script that has at least this share of its letters.
SCRIPT_SHARE = 0.002
SMOOTH = 0.5
#: Groups that the counts of a language meet in, and pieces that they are cut into.
SALTS, PIECES = 256, 16
#: Bytes of text that are scored together, divided by the number of languages above four.
AT_ONCE = 1 << 20

# First code points of runs of one script, and the script's number.
# 0 none, 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Devanagari, 8 Bengali, 9 Gurmukhi, 10 Gujarati,
# 11 Tamil, 12 Telugu, 13 Kannada, 14 Malayalam, 15 Sinhala, 16 Thai, 17 Lao, 18 Tibetan, 19 Myanmar, 20 Georgian,
# 21 Hangul, 22 Ethiopic, 23 Khmer, 24 Kana, 25 Han
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00BA, 1), (0x00BB, 0), (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1),
    (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0),
    (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16), (0x0E80, 17), (0x0F00, 18), (0x1000, 19), (0x10A0, 20), (0x1100, 21), (0x1200, 22), (0x13A0, 0),
    (0x1780, 23), (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3041, 24), (0x3100, 0), (0x3130, 21), (0x3190, 0), (0x3400, 25), (0x4DC0, 0), (0x4E00, 25), (0xA000, 0),
    (0xAC00, 21), (0xD7B0, 0), (0xF900, 25), (0xFB00, 1), (0xFB07, 0), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 24), (0xFFA0, 0), (0x20000, 25), (0x30000, 0),
]
_RUNS = np.array([a for a, _ in SCRIPTS])
_KINDS = np.array([k for _, k in SCRIPTS], dtype=np.int64)
N_SCRIPTS = 26
_WORDY = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _WORDY.finditer(text))


def script_of_bytes(raw: np.ndarray) -> np.ndarray:
    """At each first byte of a character, the script of the character; 0 elsewhere."""
    out = np.zeros(len(raw), dtype=np.int64)
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    out[ascii_letter] = 1
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
        two = ((b0 & 0x1F) << 6) | (b1 & 0x3F)
        three = ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
        four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
        point = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        out[lead] = _KINDS[np.searchsorted(_RUNS, point, "right") - 1]
    return out


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte, the bucket of the n-gram that ends one byte after it; white space, and what lies outside of its text, counts as spaces.

    ``at``: the offsets of the texts in the bytes.
    """
    flat = np.where(SPACE[raw], np.uint8(32), raw)
    flat = np.insert(flat, np.repeat(at[1:-1], GRAM - 2), np.uint8(32)).astype(np.uint32)
    padded = np.concatenate([np.full(GRAM - 2, 32, np.uint32), flat, np.full(1, 32, np.uint32)])
    n = len(flat)
    gram = np.zeros(n, dtype=np.uint32)
    for k in range(GRAM):
        gram = (gram << np.uint32(8)) | padded[k : k + n]
    gram = gram[np.arange(len(raw)) + (GRAM - 2) * np.repeat(np.arange(len(at) - 1), np.diff(at))]
    return ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int64)


@dataclass
class Model:
    """langs in order; table: log-probability by language and bucket; scripts: candidates by script."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray


def train(docs: DataFrame, modulus: int | None = 5) -> Model:
    """Learns from every row of ``docs`` with a lang, but those whose crc32(doc_id as text) mod ``modulus`` is 0.

    Counts of n-grams in a fixed number of buckets per language are summed in tasks, in salted groups and
    then per language; what reaches the driver is half a MB per language. A null doc_id counts as empty text.
    """
    shared.ship(docs.sparkSession)
    rows = docs.where("lang is not null")
    if modulus:
        rows = rows.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus != 0)
    size = 1 << BUCKETS_LOG2

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                some = batch.column("text").filter(pa.array(langs == lang))
                total = sums.setdefault(lang, np.zeros(size + N_SCRIPTS, dtype=np.int64))
                raw, at = buffers(pc.utf8_lower(some))
                for _, _, part, offsets in slices(raw, at, AT_ONCE):
                    total[:size] += np.bincount(features(part, offsets)[~SPACE[part]], minlength=size)
                    total[size:] += np.bincount(script_of_bytes(part), minlength=N_SCRIPTS)
        if sums:
            whole = pa.array([-1] * len(sums), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), whole, pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "part", "counts"])

    def add(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, part, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "counts")), strict=True):
                if part < 0:
                    pieces = np.array_split(np.frombuffer(data, dtype=np.int64), PIECES)
                else:
                    pieces = {part: np.frombuffer(data, dtype=np.int64)}.values()
                for i, piece in zip(range(PIECES) if part < 0 else [part], pieces, strict=True):
                    key = lang, i
                    sums[key] = sums[key] + piece if key in sums else piece
        if sums:
            langs, parts = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "part", "counts"])

    kind = "lang string, part int, counts binary"
    found = rows.select("lang", "text").mapInArrow(bounded(count), kind)
    # What tasks counted meets in salted groups first, then piece by piece: no task takes a row of every other task.
    found = found.withColumn("salt", F.spark_partition_id() % SALTS).repartition("lang", "salt").drop("salt").mapInArrow(bounded(add), kind)
    found = found.repartition("lang", "part").mapInArrow(bounded(add), kind).collect()  # PIECES rows of each language
    whole: dict[str, list] = {}
    for lang, _, data in sorted(found, key=lambda r: (r.lang, r.part)):
        whole.setdefault(lang, []).append(data)
    found = [(lang, b"".join(data)) for lang, data in whole.items()]
    counts = {lang: np.frombuffer(c, dtype=np.int64) for lang, c in found}
    langs = sorted(counts)
    grams = np.array([counts[x][:size] for x in langs], dtype=np.float64).reshape(-1, size) + SMOOTH
    scripts = np.array([counts[x][size:] for x in langs], dtype=np.float64).reshape(-1, N_SCRIPTS)
    letters = np.maximum(scripts[:, 1:].sum(axis=1, keepdims=True), 1)
    may = scripts / letters >= SCRIPT_SHARE
    return Model(langs, np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), may)


def word_scores(model: Model, raw: np.ndarray, at: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word for each language, relative to its best candidate; bytes in letters of each word.

    A word without letters, or in a script of no language, scores 0 for all and weighs nothing.
    """
    n_words, n_langs = len(words.starts), len(model.langs)
    scores = np.zeros((n_words, n_langs))
    if not n_words or not n_langs:
        return scores, np.zeros(n_words)
    script = script_of_bytes(raw)
    letter = np.concatenate([[0], np.cumsum(script > 0)])
    weight = letter[words.ends] - letter[words.starts]
    bucket = features(raw, at)
    for k in range(n_langs):
        total = np.concatenate([[0.0], np.cumsum(model.table[k][bucket], dtype=np.float64)])
        scores[:, k] = total[words.ends] - total[words.starts]
    may = np.ones((n_words, n_langs), dtype=bool)
    own = np.repeat(np.arange(n_words), words.ends - words.starts)
    inside = script[np.repeat(words.starts - np.concatenate([[0], np.cumsum(words.ends - words.starts)[:-1]]), words.ends - words.starts) + np.arange(len(own))] if (script > 1).any() else None
    if inside is not None:
        for kind in np.unique(inside[inside > 0]).tolist():
            may[np.unique(own[inside == kind])] &= model.scripts[:, kind]
    elif not model.scripts[:, 1].all():
        may[weight > 0] &= model.scripts[:, 1]
    scores[~may] = -1e9
    plain = (weight == 0) | ~may.any(axis=1)
    scores[plain] = 0
    weight = np.where(plain, 0, weight)
    scores -= scores.max(axis=1, keepdims=True)
    return scores, weight


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path of its text; texts go through word positions together."""
    n_words, n_langs = scores.shape
    label = np.zeros(n_words, dtype=np.int64)
    if n_langs < 2 or not n_words:
        return label
    order = np.argsort(-np.diff(bounds), kind="stable")
    starts, sizes = bounds[:-1][order], np.diff(bounds)[order]
    came = np.zeros((n_words, n_langs), dtype=np.int16)
    active = int((sizes > 0).sum())
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if active else 0) + 1), "right")
    best = scores[starts[:active]]
    finals = np.zeros(len(sizes), dtype=np.int64)
    own = np.arange(n_langs)
    for t in range(1, len(alive)):
        k = alive[t]
        if k < len(best):
            finals[k : len(best)] = best[k:].argmax(axis=1)
            best = best[:k]
        top = best.argmax(axis=1)
        other = best[np.arange(k), top][:, None] - switch
        stay = best >= other
        at = starts[:k] + t
        came[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, other) + scores[at]
    finals[: len(best)] = best.argmax(axis=1)
    state = np.zeros(0, dtype=np.int64)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        state = np.concatenate([state, finals[len(state) : k]])
        at = starts[:k] + t
        label[at] = state
        if t:
            state = came[at, state].astype(np.int64)
    return label


def identify_texts(model: Model, texts: pa.Array, switch: float = SWITCH, with_spans: bool = False) -> Iterator[tuple[str, float, str | None]]:
    """(language, score, spans) of each text, in order."""
    original = texts.to_pylist()
    lowered = pc.utf8_lower(texts)
    if with_spans:  # offsets are those of the text itself, so it must not change length
        lowered = pa.array([None if t is None else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in original], pa.large_string())
    raw, at = buffers(lowered)
    for first, end, part, offsets in slices(raw, at, max(1 << 16, 4 * AT_ONCE // max(len(model.langs), 4))):
        words = Words(part, offsets)
        scores, weight = word_scores(model, part, offsets, words)
        label = viterbi(scores, words.bounds, switch)
        n_langs = max(len(model.langs), 1)
        share = np.bincount(words.texts() * n_langs + label, weights=weight, minlength=(end - first) * n_langs).reshape(-1, n_langs)
        total = share.sum(axis=1)
        for i in range(end - first):
            if not model.langs or not has_letter(original[first + i]):
                yield UNKNOWN, 0.0, "" if with_spans else None
                continue
            if total[i]:
                k = int(share[i].argmax())
                score = float(share[i, k] / total[i])
            else:  # letters of no known script: no candidate stands out
                k, score = 0, 1.0 / n_langs
            spans = None
            if with_spans:
                b, e = words.bounds[i], words.bounds[i + 1]
                mine = label[b:e]
                cuts = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), len(mine)]
                cp = np.concatenate([[0], np.cumsum((part[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
                where = [(cp[words.starts[b + x] - offsets[i]], cp[words.ends[b + y - 1] - offsets[i]], mine[x]) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x]
                spans = ",".join(f"{model.langs[m]}:{x}:{y}" for x, y, m in where)
            yield model.langs[k], score, spans


def identify(docs: DataFrame, model: Model, modulus: int = 5, switch: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (and spans: language:start:end in code points).

    lang_pred is ``und`` (score 0) where the text is null or has no letter, or nothing was learned; score is the share
    of the text's letters in spans of lang_pred. Ties go to the first language in code-point order. A
    null doc_id counts as empty text in ``held_out``. Repeated rows give repeated rows, an empty table an empty one.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    sent = spark.sparkContext.broadcast(model)  # languages x a fixed number of buckets

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 1024):
                some = batch.slice(first, 1024)
                lang, score, spans = zip(*identify_texts(sent.value, some.column("text"), switch, with_spans), strict=True)
                arrays = [some.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())] + [pa.array(spans, pa.string())] * with_spans
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"] + ["spans"] * with_spans)

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + ", spans string" * with_spans
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0
    out = docs.select("doc_id", "text").mapInArrow(bounded(run), kind).withColumn("held_out", held)
    return out.select("doc_id", "held_out", "lang_pred", "score", *["spans"] * with_spans)


def with_language(docs: DataFrame, modulus: int = 5, switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns; ``lang`` is the predicted one. Those of ``und`` go.

    The model learns from ``docs`` itself as in ``train``. Without anything to learn from only null texts and those
    without a letter go, and ``lang`` stays null. Repeated rows stay repeated, an empty table stays empty, and columns
    of any other name, ``score`` and ``lang_pred`` too, pass through.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    sent = spark.sparkContext.broadcast(train(docs, modulus))
    place = docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 1024):
                some = batch.slice(first, 1024)
                if sent.value.langs:
                    lang = [lang for lang, _, _ in identify_texts(sent.value, some.column("text"), switch)]
                    keep = [x != UNKNOWN for x in lang]
                    some = some.set_column(place, some.schema.field(place), pa.array(lang, pa.string()).cast(some.schema.field(place).type))
                else:
                    keep = [has_letter(t) for t in some.column("text").to_pylist()]
                if any(keep):
                    yield some.filter(pa.array(keep))

    return docs.mapInArrow(bounded(run), docs.schema)
