"""Texts of some hundred thousand words, beside short ones, go through whole."""

import hashlib
import random

import numpy as np

from genomill.llm import exact_dedup, jaccard, kneser_ney, mixing

N = 60_000


def long_rows():
    r = random.Random(11)
    words = [f"w{r.randrange(20_000)}" for _ in range(N)]
    changed = list(words)
    for i in range(0, N, 400):
        changed[i] = "other"
    other = [f"v{r.randrange(20_000)}" for _ in range(N)]
    texts = [" ".join(words), "  ".join(words), " ".join(changed), " ".join(other), "a few words only", None]
    return words, changed, [(i, t, "s") for i, t in enumerate(texts)]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_long_texts(spark):
    words, changed, rows = long_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    one, two = shingles(words), shingles(changed)
    assert 100 * len(one & two) >= 80 * len(one | two)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got[0] == (len(one), 0) and got[1] == (len(one), 0) and got[2] == (len(two), 0) and got[3][1] == 3 and got[5] == (0, 5)
    same = {r.doc_id: r for r in exact_dedup.assign(docs).collect()}
    assert same[1].keep_id == 0 and same[0].group_size == 2 and same[1].text_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()
    scores = {r.doc_id: r for r in kneser_ney.score(docs, kneser_ney.train(docs, order=3)).collect()}
    assert scores[0].n_tokens == N + 1 and scores[0].score == scores[1].score and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in scores.values())
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()} == {0: N, 1: N, 2: N, 3: N, 4: 4, 5: 0}
