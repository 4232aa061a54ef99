import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from genomill.llm import language, mixing

EN = ["the", "house", "with", "thing", "that", "wash", "she", "there", "when", "shall"]
DE = ["der", "schön", "über", "nicht", "straße", "ich", "zwei", "haus", "wärme", "auch"]
RU = ["привет", "мир", "дом", "окно", "книга"]


def corpus(n=300):
    r = random.Random(1)
    return [(i, " ".join(r.choice((EN, DE, RU)[i % 3]) for _ in range(r.randint(4, 40))), ("en", "de", "ru")[i % 3], f"s{i % 4}") for i in range(n)]


def test_held_out_accuracy_and_spans(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    assert model.langs == ["de", "en", "ru"]
    rows = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [i for i in rows if crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in held) for i in rows)
    assert np.mean([rows[i].lang_pred == ("en", "de", "ru")[i % 3] for i in held]) > 0.98
    text = "the house with that thing der schön über nicht straße"
    (lang, score, spans), *_ = language.identify_texts(model, pa.array([text]), switch=3.0, with_spans=True)
    assert spans == f"en:0:25,de:26:{len(text)}" and 0.4 < score < 0.7
    assert next(language.identify_texts(model, pa.array(["мир house мир мир"])))[0] == "ru"


def test_odd_texts(spark):
    docs = spark.createDataFrame([*corpus(60), (None, "the house", "en", None), (900, None, None, "x"), (901, " 12 ½ -", None, "x"), (902, "", "en", None), (903, "漢字", None, None), (903, "漢字", None, None), (904, "the " * 20_000, None, None)], "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    rows = language.identify(docs, model, with_spans=True).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 67 and all(0 <= r.score <= 1 for r in rows)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred in model.langs and by[904].lang_pred == "en" and by[904].spans == "en:0:79999"
    assert language.with_language(docs).count() == 64 and language.with_language(docs).columns == docs.columns
    empty = docs.limit(0)
    assert language.identify(empty, language.train(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(4)
    for _ in range(20):
        bounds = np.concatenate([[0], np.cumsum(r.integers(0, 6, 5))])
        scores = r.normal(size=(bounds[-1], 3)) * 3
        got = language.viterbi(scores, bounds, 2.0)
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            n = e - b
            value = lambda path, b=b: sum(scores[b + i, k] for i, k in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            best = max((value(p) for p in np.ndindex(*[3] * n)), default=0)
            assert value(tuple(got[b:e])) == pytest.approx(best)


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = budget * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in order}
        full |= set(over)


@pytest.mark.parametrize("block", [4096, 50])
def test_mix(spark, block):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.1) * 5)), r.choice(["a", "b", "é", None, "a", "a"])) for i in range(700)]
    rows += [(1000, None, "a"), (1001, "", "zero"), (None, "x y", "b"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block=block).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    taken: dict = {}
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and x.taken in (0, x["size"], 2 * x["size"])
        taken[x.source] = taken.get(x.source, 0) + x.taken
    most = {s: max(x["size"] for x in got if x.source == s) for s in taken}
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= max(1, most[s]) for s in taken)
    wanted = {s: sum(x["size"] > 0 for x in got if x.source == s) * want[s] / sizes[s] for s in taken if sizes[s]}
    assert all(abs(sum(x.times for x in got if x.source == s) - n) <= 3 for s, n in wanted.items())
    again = mixing.mix_sources(docs.repartition(7), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed(docs, block=block)
    assert mixed.columns == docs.columns and mixed.count() == sum(x.times for x in got)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0)] * 2


def test_flight_keeps_totals():
    r = np.random.default_rng(6)
    p, z = r.random(400), r.integers(1, 500, 400).astype(float)
    out = mixing.flight(p, z, r.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.sum() == pytest.approx(p.sum()) and out @ z == pytest.approx(p @ z)
    end = mixing.landing(out, z)
    assert set(end) <= {0.0, 1.0}


def test_texts_stay_where_no_language_is_known(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(["some words", None, "", "12 34", "mehr Text"])], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.with_language(docs).collect()) == [0, 4]


def test_columns_of_the_same_names(spark):
    more = "score double, lang_pred string, held_out int, spans string, size int, target string, taken long, times int, copy int, p double, source_size long, blocks long, key long, rows int, nth int"
    rows = [(i, t, k, s, *[None] * 15) for i, t, k, s in corpus(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + more)
    plain = docs.select("doc_id", "text", "lang", "source")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(language.identify(docs, language.train(docs)), language.identify(plain, language.train(plain)))
    assert same(mixing.mix_sources(docs), mixing.mix_sources(plain))
    assert same(mixing.mixed(docs).select("doc_id", "text", "lang", "source"), mixing.mixed(plain)) and mixing.mixed(docs).columns == docs.columns
    assert language.with_language(docs).columns == docs.columns and language.with_language(docs).select("score").distinct().collect() == [(None,)]


def test_counts_meet_in_salted_groups(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(120), "doc_id long, text string, lang string, source string")
    one = language.train(docs.coalesce(1))
    monkeypatch.setattr(language, "SALTS", 3)
    several = language.train(docs.repartition(9))
    assert one.langs == several.langs and (one.table == several.table).all() and (one.scripts == several.scripts).all()
    found = lambda d: sorted(map(str, language.identify(d, one, with_spans=True).collect()))
    assert found(docs.coalesce(1)) == found(docs.repartition(9))
