"""The model against a plain one over tuples of words."""

import math
import os
import re
import time
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from genomill.llm import contexts, kneser_ney


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(rows, order):
    """Scores by id of interpolated modified Kneser-Ney over tuples."""
    learn = [words(t) for i, t in rows if crc32(str(i).encode()) % 7 != 2]
    level = Counter()
    for w in learn:
        padded = [0] * (order - 1) + w
        level.update(tuple(padded[k : k + order]) for k in range(len(w)))
    raw = Counter(x for w in learn for x in w)
    counts = {order: level}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter()
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] += c if k > 1 and g[1] == 0 else 1
    sums, cut = {}, {}
    for k, table in counts.items():
        by = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in table.items():
            by[g[:-1]][0] += c
            by[g[:-1]][min(c, 3)] += 1
        sums[k] = by
        cut[k] = kneser_ney.discounts([sum(c == j for c in table.values()) for j in (1, 2, 3, 4)])

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(raw) + 1)
        lower = p(g[1:])
        if g[:-1] not in sums[k]:
            return lower
        total, *n = sums[k][g[:-1]]
        c, d = counts[k][g], cut[k]
        return (c - d[min(c, 3)]) / total + sum(x * y for x, y in zip(d[1:], n, strict=True)) / total * lower

    n = sum(raw.values())
    out = {}
    for i, t in rows:
        w = words(t)
        padded = [0] * (order - 1) + w
        score = sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(w)))
        base = sum(math.log10((raw[x] + 1) / (n + len(raw) + 1)) for x in w)
        out[i] = (crc32(str(i).encode()) % 7 == 2, len(w), sum(raw[x] > 0 for x in w), n, base, score)
    return out, p, raw


TEXTS = ["the cat sat on the mat", "The cat sat on a mat\tagain", "a dog sat", None, "", "  ", "é ñ É", "the the the the", "dog cat dog cat dog", "x" * 500, "on the mat the cat sat"] * 3


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TEXT_PER_PART", 200)
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, score string, base_score double")
    model = kneser_ney.train(docs.repartition(3), order=order)
    got = {r.doc_id: tuple(r)[1:7] for r in kneser_ney.score(docs, model).collect()}
    want, p, raw = plain(rows, order)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4], i
        assert got[i][4:] == pytest.approx(want[i][4:]), i
    context = ("the", "cat")[: order - 1] if order < 3 else ("cat", "sat")
    assert sum(p((*context, w)) for w in raw) + p((*context, "unknown")) == pytest.approx(1)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = kneser_ney.train(docs)
    assert kneser_ney.score(docs, model).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = kneser_ney.score(odd, kneser_ney.train(odd)).collect()
    assert len(rows) == 4 and all(r.score < 0 for r in rows)
    untrained = kneser_ney.score(odd, model).collect()
    assert all(r.score == r.base_score == 0 and r.train_tokens == 0 for r in untrained)


def test_the_query_has_trigrams(spark, tmp_path):
    from genomill.llm import queries

    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op1_lm_scoring(spark, str(tmp_path)).collect()}
    want = plain(rows, 3)[0]
    assert {i: got[i] for i in want} == pytest.approx({i: want[i][5] for i in want})


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


@pytest.mark.parametrize("top", [100, 30_000])
def test_places_in_runs(top):
    draw = np.random.default_rng(3)
    runs = [np.unique((top * draw.random(n) ** 2).astype(np.int64)) for n in (0, 1, 2, 3, 300, 5_000)]
    flat, ends = np.concatenate(runs), np.cumsum([len(x) for x in runs])
    for run, end in zip(runs, ends, strict=True):
        want = np.arange(-1, top)
        got = contexts.within(lambda i: flat[i], np.full(len(want), end - len(run)), np.full(len(want), end), want, top)
        place = {x: end - len(run) + i for i, x in enumerate(run.tolist())}
        assert got.tolist() == [place.get(x, -1) for x in want.tolist()]


def test_numbers_of_any_size():
    draw = np.random.default_rng(5)
    for high in (1, 200, 70_000, 1 << 25, 1 << 40):
        rows = [draw.integers(0, high, 3_000), draw.integers(0, 3, 3_000)]
        out = {}
        contexts.put_numbers(out, "n", rows[0])
        contexts.put_rising(out, "r", np.sort(rows[0]) >> 8)
        contexts.put_coded(out, "c", rows)
        back = contexts.opened(contexts.bundle(out))
        i = draw.permutation(3_000)
        assert (contexts.numbers(back, "n")(i) == rows[0][i]).all()
        assert (contexts.rising(back, "r")(i) == (np.sort(rows[0]) >> 8)[i]).all()
        for got, row in zip(contexts.coded(back, "c", 2)(i), rows, strict=True):
            assert (got == row[i]).all()


def test_disk_of_trigrams(spark, monkeypatch):
    """No shuffle stays behind, and a different trigram takes less than 24 bytes of the model, all lower orders and sums included."""
    monkeypatch.setattr(kneser_ney, "TEXT_PER_PART", 120_000)
    draw = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in (20_000 * draw.random(2_000) ** 4).astype(int)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    before = shuffle_bytes(spark)
    model = kneser_ney.train(docs, order=3)
    for _ in range(50):  # Spark removes them in the background
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) <= before
    top = model.uri.removeprefix("file://")
    size = sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(top) for f in names)
    assert model.parts > 2 and len(model.frequent)
    assert size < 24 * model.seen[3][5]
