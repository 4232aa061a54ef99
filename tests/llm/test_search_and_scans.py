import random
import re

import numpy as np
import pytest

from genomill.llm import kdtree, licenses, personal, wrappers


def edge(score):
    return min(max(score, -(1 << 63)), (1 << 63) - 1)


def plain_top(rows, k=20, every=20):
    ok = [(u, i, [int(np.floor(64 * float(x))) for x in v]) for u, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for u, i, q in ok:
        if i is None or i % every:
            continue
        scored = sorted((-edge(sum(a * b for a, b in zip(q, c, strict=True))), j is None, j or 0, w) for w, j, c in ok if w != u and len(c) == len(q))
        out += [(i, r, None if none else j, -s) for r, (s, none, j, _) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("shard, block, k", [(16_384, 4096, 20), (40, 3, 5)])
def test_top_k(spark, shard, block, k):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i + 300, rows[i][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [9.0] * 6), (420, []), (440, [1.0, 2.0]), (441, [1.0, 3.0]), (460, [1e30] * 6), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = kdtree.top_k(df, k=k, shard=shard, block=block).collect()
    want = plain_top(rows, k)
    assert sorted(map(str, [tuple(x) for x in got])) == sorted(map(str, want))
    assert kdtree.top_k(df.limit(0)).count() == 0


def test_regions_hold_their_vectors_and_spare_searches(spark):
    r = np.random.default_rng(9)
    v = np.floor(r.normal(size=(1000, 4)) * 64)
    splits = kdtree.Splits(v[:300], 16)
    assert sorted(set(splits.place(v).tolist())) == list(range(16))
    assert (kdtree.Splits(np.ones((50, 3)), 8).place(np.ones((5, 3))) == 0).all()
    centres = r.normal(size=(12, 6)) * 40
    rows = [(i, (centres[i % 12] + r.normal(size=6) * 0.1).tolist()) for i in range(1200)] + [(2000 + i, [5.0] * 6) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counted = []
    keep = kdtree.shared.keep
    kdtree.shared.keep = lambda df, name: (out := keep(df, name), counted.append((name, out)))[0]
    try:
        got = kdtree.top_k(df, k=3, shard=50, block=10).collect()
    finally:
        kdtree.shared.keep = keep
    tables = dict(counted)
    assert sorted(map(str, [tuple(x) for x in got])) == sorted(map(str, plain_top(rows, 3)))
    shards = tables["regions"].agg({"shards": "sum"}).first()[0]
    queries = sum(i % 20 == 0 for i, _ in rows)
    assert tables["sent"].count() < queries * (shards - 1) / 2


def test_bounds_of_boxes():
    r = np.random.default_rng(8)
    v, q = np.floor(r.normal(size=(500, 5)) * 64), np.floor(r.normal(size=(20, 5)) * 64)
    tree = kdtree.Tree(v, leaf=16)
    for j, (b, e) in enumerate(zip(tree.begins, tree.ends, strict=True)):
        assert e - b <= 16 and ((q @ tree.vectors[b:e].T).max(axis=1) <= tree.bounds(q)[:, j]).all()
    assert sorted(tree.order.tolist()) == list(range(500))


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"][0]
    odd = "Copyright (c) 2020 Someone\n\n" + mit.replace(",", " ;").upper().replace("COPIES", "copies\n  *")
    rows = [
        (1, odd, "x"), (2, "Text.\nReleased under the MIT Licence.\nMore\nLicensed under CC BY-NC 4.0\n", "x"), (3, None, None), (4, "", "x"), (5, "© 2001 A\nAll rights reserved.", "x"), (6, mit + " and more", "x"),
        (None, "© 2019\nDistributed under the Apache License, Version 2.0", "x"), (1, odd, "x"), (8, "word " * 20_000, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = licenses.scan(docs).collect()
    by = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in got}
    assert len(got) == len(rows) and by[1] == ("MIT", 0, "") and by[2] == (None, 2, "CC-BY-NC-4.0,MIT") and by[6] == (None, 0, "") and by[8] == (None, 0, "")
    assert by[3] == by[4] == by[5] == (None, 0, "") and by[None] == ("Apache-2.0", 1, "Apache-2.0")
    assert licenses.scan(docs, [("own", "some text")]).where("license_id is not null").count() == 0
    assert licenses.scan(docs, []).count() == len(rows) and licenses.scan(docs.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and personal.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_fixed_patterns():
    r = random.Random(9)
    for _ in range(4000):
        text = "".join(r.choice("ab1290.@+-()  45%_é") for _ in range(r.randint(0, 50)))
        assert personal.base_spans(text) == plain_spans(text)
    assert personal.base_spans("9" * 200_000) == [] and personal.base_spans("a" * 200_000) == [] and personal.base_spans("1." * 50_000 + "300") == plain_spans("1." * 50_000 + "300")


@pytest.fixture(scope="module")
def field():
    return personal.train()


def test_field_on_sentences_it_has_not_seen(field):
    right = wrong = missed = 0
    for text, gold in personal.generated(99, 200):
        got = set(personal.added_spans(field, text, []))
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.95


def test_field_s_best_path_is_the_best_of_all(field):
    text = "tel 555-123-4567 0 card 4111 1111 1111 1111 mail a at b dot com"
    segments = [s for s in field.scored(personal.candidates(text)) if s[3] > 0]
    best = 0.0
    r = random.Random(10)
    for _ in range(3000):
        r.shuffle(segments)
        free, total = [], 0.0
        for s in segments:
            if all(s[1] <= a or s[0] >= b for a, b in free):
                free.append(s[:2])
                total += s[3]
        best = max(best, total)
    got = field.decode(personal.candidates(text))
    score = {(s[2], s[0], s[1]): s[3] for s in segments}
    assert sum(score[x] for x in got) >= best - 1e-9 and {k for k, _, _ in got} == {"phone", "card", "email"}


def test_personal_rows(spark, field):
    rows = [(1, "mail me.1@ab.example.com or +1 (555) 010-1234", 0), (2, None, 0), (3, "", 0), (None, "at 10.0.0.255 é 4111 1111 1111 1111", 0), (5, "call (555) 010-1234 now", 0), (5, "call (555) 010-1234 now", 0), (6, "x " * 50_000 + "7.7.7.7", 0)]
    got = personal.find(spark.createDataFrame(rows, "doc_id long, text string, spans int"), field).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].spans == "email:5:24,phone:28:45" and by[2].spans == "" and by[None].spans == "ip:3:13,card:16:35" and by[6].spans == "ip:100000:100007"
    assert by[5].spans == "phone:5:19" and by[5].n_phone == 0 and by[5].n_added == 1 and (by[1].n_email, by[1].n_phone) == (1, 1)
    assert personal.find(spark.createDataFrame([], "doc_id long, text string"), field).count() == 0


PAGE = '<!DOCTYPE html><html><head><title>T{i}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A{i}</a></li></ul></nav><div class="ad">Buy {i}</div>{main}<aside>side</aside><section class="comments"><p>Nice {i}</p></section><footer>&copy; site</footer></body></html>'


def test_extract():
    article = "<article><header><h1>Head &amp; &lt;more&gt;</h1></header><p><b>One<br>two <i>th</i>ree\n\n<p>Four<form><input>send</form></p><div class='share'>tweet</div></article>"
    assert wrappers.extract(PAGE.replace("{main}", article)) == "Head & <more> One two three Four"
    assert wrappers.extract("<p>plain &eacute;<p>text") == "plain é text" and wrappers.extract("no tags < 5 & more") == "no tags < 5 & more"
    assert wrappers.extract("<article><p>cut off <b>bold") == "cut off bold" and wrappers.extract("<article></article>") == "" and wrappers.extract("<!-- <p>x</p> ") == ""
    assert wrappers.extract("<article>" + "<div>" * 300 + "deep" + "</article>") == "deep"


def test_wrappers_find_what_varies(spark):
    page = '<html><body><div class="top">Welcome to the site of everything</div><div class="x">{i} first part of number {i} that differs<p>and more of {i}</p></div><div class="low">Always the same words at the end of it</div></body></html>'
    rows = [(i, f"http://h.example/{i}", page.replace("{i}", str(i) * 3), 1) for i in range(12)]
    rows += [(100, "http://one.example/", PAGE.replace("{main}", "<article><p>only</p></article>"), 1), (101, None, None, 1), (102, "no host", "", 1), (None, "http://one.example/2", "<p>x</p>", 1), (3, rows[3][1], rows[3][2], 1)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[3] == "333 first part of number 333 that differs and more of 333" and by[100] == "only" and by[101] == by[102] == "" and by[None] == "x"
    assert all(r.n_chars == len(r.text) for r in got) and wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching():
    a, b = (wrappers.folded(wrappers.parse(x)) for x in ("<div><p>1</p><ul><li>x</ul></div>", "<div><h1>0</h1><p>2</p><ul><li>x<li>y</ul></div>"))
    assert wrappers.matching(a, b) == 5 and [wrappers.pairs(a[3][0], b[3][0])] == [[(0, 1), (1, 2)]]
    both = wrappers.aligned(a, b)
    assert [(c[0], c[1]) for c in both[3][0][3]] == [("h1", 1), ("p", 2), ("ul", 2)]


def test_template_is_counted_over_all_pages_of_a_host(spark):
    # 40 pages of one type and 5 of another, and wording that a few of the many pages share by chance
    often = '<body><div class="often"><p>{i} one text {i}</p><p>{same}</p></div></body>'
    seldom = '<body><div class="seldom"><p>{i} other text {i}</p><div class="x">Rare menu</div></div></body>'
    rows = [(i, f"http://h.example/{i}", often.replace("{i}", f"w{i}").replace("{same}", "Same by chance" if i < 12 else f"last {i}")) for i in range(40)]
    rows += [(i, f"http://h.example/{i}", seldom.replace("{i}", f"w{i}")) for i in range(40, 45)]
    rows += [(50, "http://copies.example/a", "<p>a copied page"), (51, "http://copies.example/b", "<p>a copied page"), (52, "http://copies.example/c", "<p>a copied page")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[i] == f"w{i} one text w{i} Same by chance" for i in range(12)) and got[20] == "w20 one text w20 last 20"
    assert all(got[i] == f"w{i} other text w{i}" for i in range(40, 45)) and {got[50], got[51], got[52]} == {"a copied page"}


def test_the_wrapper_decides_pages_with_an_article(spark):
    page = "<body><article><h1>{i} head</h1><div>Get our letter every week</div><p>{i} text</p></article></body>"
    cards = "<body><article><p>{i} see too</p></article><div>{i} the story itself is here, outside the card, and it is long</div></body>"
    rows = [(i, f"http://a.example/{i}", page.replace("{i}", f"w{i}")) for i in range(5)]
    rows += [(i, f"http://b.example/{i}", cards.replace("{i}", f"w{i}")) for i in range(5, 10)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"w{i} head w{i} text" for i in range(5))
    assert all(got[i] == f"w{i} see too w{i} the story itself is here, outside the card, and it is long" for i in range(5, 10))


def test_all_varying_text_stays():
    long = "story " * 30
    assert wrappers.extract(f"<body><div class=lead>Headline and lead</div><div class=story>{long}</div><p>The end</p></body>") == f"Headline and lead {long}The end"


def test_all_articles_of_a_page_stay():
    parts = "<body><article><p>Part one, longest</p></article><article class=related-posts>Teaser</article><div><article>Part two</article></div></body>"
    assert wrappers.extract(parts) == "Part one, longest Part two"


def test_licence_files(spark):
    isc = licenses.TEXTS["ISC"][0].replace("above copyright notice", "above\ncopyright notice")
    star = licenses.TEXTS["BSD-3-Clause"][0].replace(" 1. ", "\n* ").replace(" 2. ", "\n* ").replace(" 3. ", "\n* ")
    with open(f"{licenses.FULL}/Apache-2.0.txt") as file:
        apache = file.read()
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + licenses.TEXTS["MIT"][0]), (2, "ISC License\n\nCopyright Jane Doe\n\n" + isc), (3, isc), (4, "Copyright 2001, A\n" + star), (5, apache), (6, apache.replace("\n", "\n\n").upper()),
        (7, "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + licenses.TEXTS["BSL-1.0"][0]), (8, "copyright notice that is text"), (9, "Copyright Jane Doe"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license_id for i in range(1, 10)] == ["MIT", "ISC", "ISC", "BSD-3-Clause", "Apache-2.0", "Apache-2.0", "BSL-1.0", None, None]
    assert got[2].notices == "ISC" and "BSL-1.0" in got[7].notices and got[8].canonical_sha256 != got[9].canonical_sha256


def test_deep_markup():
    deep = "<body>" + "<div>" * 20_000 + "a text" + "</div>" * 20_000 + "<nav>menu</nav></body>"
    assert wrappers.extract(deep) == "a text" and [t for _, t, _ in wrappers.units(wrappers.parse(deep))] == ["a text"]


def test_equal_words_in_a_row(spark):
    rows = [(1, "Licence licence LICENCE, copyright owner copyright owner"), (2, "license license license copyright holder copyright holder")]
    got = {r.doc_id: r.canonical_sha256 for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2]
