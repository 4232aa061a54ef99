"""run() against plain Python: letters decide the first stage, then equal texts, sets of shingles, targets, the library."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from genomill.llm import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, size long, nth int, digest string"
WHITE = re.compile("[\x20\t-\r]+")
WORD = re.compile("[^\x20\t-\r]+")


def tables():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(800)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [prose(r.randint(1, 60)) for _ in range(60)]
    texts += [None, "", "  ", "12 34 - 5", "12 34 - 5", "x", "漢字 仮名", "A" * 5000, "word " * 3000, prose(20_000)]
    texts += [texts[3], texts[3].replace(" ", "\n", 2), texts[4].upper(), texts[5] + "  "]
    long = prose(200).split(" ")
    texts += [" ".join(long), " ".join([*long, "tail"]), " ".join(long[1:]), " ".join([*long[:100], "changed", *long[101:]])]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None, "a", "a"]), -1, 0.5, "no", 9, 1, "d") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, prose(12), "en", "b", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def letters(rows):
    return [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]


def equal_texts(rows):
    best = {}
    for x in rows:
        key = WHITE.sub(" ", x[1])
        if key not in best or (x[0] is not None and (best[key][0] is None or x[0] < best[key][0])):
            best[key] = x
    return list(best.values())


def similar_texts(rows):
    def shingles(text):
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text)]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(x, shingles(x[1])) for x in rows if x[0] is not None]
    least = {x[0]: x[0] for x, _ in sets}
    for _ in sets:
        for x, s in sets:
            for y, t in sets:
                if s and t and 100 * len(s & t) >= 80 * len(s | t):
                    least[x[0]] = least[y[0]] = min(least[x[0]], least[y[0]])
    return [x for x in rows if x[0] is None or least[x[0]] == x[0]]


def stages(spark, rows):
    """What each stage returns, each written and read again by the next."""
    docs, out = spark.createDataFrame(rows, SCHEMA).repartition(4), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), SCHEMA) if len(out) < 4 else stage(spark, docs, "")
        out.append(docs.collect())
    return out


def test_stages_against_plain_python(spark):
    rows = tables()
    labelled, distinct, one_each, mix, encoded = stages(spark, rows)
    ids = lambda found: sorted((x[0] is None, x[0] or 0) for x in found)
    want = letters(rows)
    assert ids(labelled) == ids(want) and all(x.lang in ("de", "en") for x in labelled)
    untouched = lambda x: (x[1], *x[3:])
    assert sorted(map(str, map(untouched, labelled))) == sorted(map(str, map(untouched, want)))
    want = equal_texts(want)
    assert ids(distinct) == ids(want) and sorted(x.text for x in distinct) == sorted(x[1] for x in want)
    want = similar_texts(want)
    assert ids(one_each) == ids(want) and len(want) < len(distinct)
    size = {x.doc_id: len(WORD.findall(x.text)) for x in one_each}
    times = {i: sum(x.doc_id == i for x in mix) for i in size}
    sources = {x.doc_id: x.source for x in one_each}
    total = sum(size.values())
    by_source = {s: sum(n for i, n in size.items() if sources[i] == s) for s in set(sources.values())}
    taken = {s: sum(n * times[i] for i, n in size.items() if sources[i] == s) for s in by_source}
    assert max(times.values()) == 2 and all(taken[s] <= 2 * n for s, n in by_source.items())
    level = {"a": 3, "b": 1, None: 2}
    free = {s for s in by_source if taken[s] < 1.98 * by_source[s]}
    left = 1.5 * total - sum(2 * n for s, n in by_source.items() if s not in free)
    for s in free:
        most = max(n for i, n in size.items() if sources[i] == s)
        assert abs(taken[s] - left * level[s] / sum(level[x] for x in free)) <= most
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert ids(encoded) == ids(mix)
    text = {x.doc_id: x.text for x in mix}
    for x in encoded:
        tokens = library.encode(text[x.doc_id], add_bos=True, add_eos=True)
        assert x.n_tokens == len(tokens) and x.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in tokens)).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(library.decode(tokens).encode()).hexdigest() and x.library_agrees


@pytest.mark.parametrize("rows", [[], [(None,) * 10], [(1, None, None, None, None, None, None, None, None, None)]])
def test_nothing_to_do(spark, rows):
    assert [len(x) for x in stages(spark, rows)] == [0] * 5


def test_run_reads_documents(spark, tmp_path):
    rows = tables()[:40]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    again = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and {x.doc_id for x in got} <= set(range(40)) and got


def test_words_of_a_batch_keep_what_is_at_hand(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    own = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ["one two three four five six", "two  three seven", "", "eight " * 3]:
        assert own.encode(text) == own.library.encode(text, add_bos=True, add_eos=True)


def test_near_copies_make_rows_by_documents_not_by_pairs(spark, monkeypatch):
    """Eighty near copies of one text, whose shingles all meet a smaller document first that is similar to none."""
    kept, keep = [], pieces.shared.keep
    monkeypatch.setattr(pieces.shared, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    words, others = [f"w{i}" for i in range(100)], [f"o{j}" for j in range(60)]
    texts = [" ".join(words[:60] + others), *(" ".join([*words, f"x{i}"]) for i in range(80)), *[" ".join(others + words[56:])] * 90]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 81]
    assert max(df.count() for df in kept if df.columns == ["a", "b"]) <= 2 * len(texts)
