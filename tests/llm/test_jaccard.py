import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from genomill.llm import components, jaccard


def brute(rows, width=5):
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    """Chains of near copies, exact copies, a passage that many share, short texts, empty ones."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(400)
    passage = [word() for _ in range(40)]
    out = [None, "", "  ", "one two", "One  two", "a b c d e", "a b c d e f", "é", "x y z"]
    while len(out) < n:
        base = [word() for _ in range(r.choice([6, 9, 30, 80, 200]))]
        kind = r.randrange(4)
        if kind == 0:
            out.append(" ".join(base + passage))
        elif kind == 1:
            out += [" ".join(base).upper()] * r.randint(1, 3)
        else:
            for _ in range(r.randint(1, 6)):  # each a copy of the one before with an edit
                out.append(" ".join(base))
                base = list(base)
                base[r.randrange(len(base))] = word()
    r.shuffle(out)
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("seed, crowd, tile", [(1, 20_000, 1024), (2, 2, 3)])
def test_components_are_those_of_all_pairs(spark, seed, crowd, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT", 0 if seed == 2 else jaccard.SENT)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, token string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, crowd=crowd).collect()}
    want = brute(rows)
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 20
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_null_ids_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (7, text), (7, text), (3, text + " end"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None)] * 2 + [(7, 3)] * 2 + [(3, 3), (4, 4), (4, 4)], key=str)
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(docs).collect()) == ["3", "4", "None", "None"]
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    for bits in jaccard.BITS:
        for _ in range(50):
            both = r.integers(0, 1 << 63, 200, dtype=np.uint64)
            x = np.unique(np.concatenate([both, r.integers(0, 1 << 63, r.integers(0, 300), dtype=np.uint64)]))
            y = np.unique(np.concatenate([both, r.integers(0, 1 << 63, r.integers(0, 300), dtype=np.uint64)]))
            a, b = jaccard.bitmap(x, bits), jaccard.bitmap(y, bits)
            common = len(np.intersect1d(x, y))
            assert jaccard.overlap_bound(a, len(x), b[None], np.array([len(y)]))[0] >= common
            small = jaccard.fold(a[None], 16)[0], jaccard.fold(b[None], 16)
            assert jaccard.overlap_bound(small[0], len(x), small[1], np.array([len(y)]))[0] >= common


def test_prefix_and_packing():
    for n in range(1, 200):
        k = jaccard.prefix_length(n)
        assert (k == 0) == (n < 4) and (not k or k == n - -(-80 * n // 100) + 1)
    r = np.random.default_rng(2)
    for top in (1 << 10, 1 << 20, 1 << 40):
        found, n = np.unique(r.integers(0, top, 500, dtype=np.uint64), return_counts=True)
        back, m = jaccard._unpacked(jaccard._packed(found, n))
        assert (back == found).all() and (m == n).all()


def test_tiles_split_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate(range(0, 60, 3))]
    rows += [(100 + i, " ".join(words[:30] + [f"y{i}.{j}" for j in range(10)])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(None, 1), (5, 5)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[node] == min(seen)
    assert set(got) == set(near) and Counter(got.values())[100] == 31


def test_texts_that_share_an_id_stay(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(5, one), (5, two), (5, two), (3, one), (7, two)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text[:1]) for r in jaccard.one_of_each(docs).collect())
    assert (3, "a") in got and got.count((5, "b")) == 1 and (7, "b") not in got


@pytest.mark.parametrize("tile", [1024, 16])
def test_links_grow_with_nodes_not_with_pairs(spark, monkeypatch, tile):
    """A group whose first node is similar to none, while all others are to each other; and one that is only nearly similar."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    kept, keep = [], jaccard.shared.keep
    monkeypatch.setattr(jaccard.shared, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    words, others = [f"w{i}" for i in range(100)], [f"o{j}" for j in range(60)]
    rows = [(0, " ".join(words[:60] + others))]
    rows += [(1 + i, " ".join([*words, f"x{i}"])) for i in range(90)]
    rows += [(200 + i, " ".join([f"p{j}" for j in range(100)] + [f"y{i}.{j}" for j in range(13)])) for i in range(60)]
    rows += [(300 + i, " ".join(others + words[56:])) for i in range(100)]  # copies: what the first node shares with the others is rarer
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute(rows) and got[90][1] == 1
    assert max(df.count() for df in kept if df.columns == ["a", "b"]) <= 2 * len(rows)


def test_links_of_tiles_join_what_is_apart(tmp_path):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(200) < share], r.integers(0, 1 << 63, 5, dtype=np.uint64)])) for share in [0.97] * 20 + [0.88] * 20]
    rows, at = [], 0
    with jaccard.sink(f"{tmp_path}/7.bin") as out:
        for s in sets:
            out.write(s.tobytes())
            rows.append(at)
            at += len(s)
    n = len(sets)
    tile = {"nodes": list(range(n)), "comps": list(range(n)), "sizes": [len(s) for s in sets], "files": [7] * n, "ats": rows, "maps": b"".join(jaccard.bitmap(s, 2048).tobytes() for s in sets)}
    batch = jaccard.pa.RecordBatch.from_pylist([{f"{t}_{k}": v for t in "ab" for k, v in tile.items()} | {"same": True}] * 2)
    links = [(a, b) for out in jaccard._tile_links([batch], str(tmp_path), jaccard.SIMILAR) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    similar = {(i, j) for i in range(n) for j in range(i + 1, n) if jaccard.is_similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert set(links) <= similar and len(links) == len(set(links)) < n < len(similar)

    def joined(edges):
        label = list(range(n))
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    assert joined(links) == joined(similar)
