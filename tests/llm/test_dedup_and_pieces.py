import hashlib
import random
import re

import public_tokenizers

from genomill.llm import exact_dedup, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, kept string, digest int"


def test_assign_ties_nulls_and_repeats(spark):
    rows = [(3, "a  b", "s", "x", 1), (1, "a b", None, None, None), (2, None, "s", "x", 1), (5, "", "s", "x", 1), (4, "c", "s", "x", 1), (4, "c", "s", "x", 1), (None, "c", "s", "x", 1), (None, "d", "s", "x", 1), (6, "a\t\nb ", "s", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id, r.text_sha256, r.kept, r.keep_id, r.group_size) for r in exact_dedup.assign(docs).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [
        (False, 1, sha("a b"), True, 1, 2), (False, 3, sha("a b"), False, 1, 2), (False, 2, sha(""), True, 2, 2), (False, 5, sha(""), False, 2, 2),
        (False, 4, sha("c"), True, 4, 3), (False, 4, sha("c"), False, 4, 3), (True, None, sha("c"), False, 4, 3), (True, None, sha("d"), True, None, 1), (False, 6, sha("a b "), True, 6, 1),
    ]
    assert got == sorted(want, key=str)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 6]


def test_short_digests_never_join_different_texts(spark):
    texts = [f"text {i % 40}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.assign(docs, salts=2, digest_bits=8).collect()}
    assert got == {i: (i % 40, 3) for i in range(120)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.assign(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0 and pieces.encode(docs, MODEL).count() == 0


def texts():
    r = random.Random(1)
    letters = "abc  éßñ▁\n\t12.,#①日😀thein"
    fixed = ["", " ", "  a", "a  b ", "\t\n x", "é ﬁ ①", "▁x ▁", "<s> a </s>", "a\u0000b", "😀", "<0x41> <unk>", "x" * 3000, "日本語 テキスト", "é", "word " * 5000]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(500)]


def test_codec_is_the_library_s():
    own = pieces.Codec(MODEL)
    for t in texts():
        ids = own.library.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids and own.decode(ids) == own.library.decode(ids)
        assert own.merge(pieces.MARK + t.replace(" ", pieces.MARK)) == ids[1:-1] or not t
    r = random.Random(2)
    for _ in range(500):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), 28705, 259, 1, 2]) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == own.library.decode(ids)


def test_encode_rows(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate([*texts()[:40], None])] + [(None, "a b", None, None, 7)] * 2
    got = pieces.encode(spark.createDataFrame(rows, SCHEMA), MODEL).collect()
    assert len(got) == len(rows) and all(r.library_agrees for r in got)
    by = {r.doc_id: r for r in got}
    assert by[40].n_tokens == 2 and by[40].decoded == "" and by[2].decoded == "  a"
    packed = b"".join(i.to_bytes(4, "little") for i in by[5].ids)
    assert by[5].ids_sha256 == hashlib.sha256(packed).hexdigest() and re.fullmatch("[0-9a-f]{64}", by[5].decoded_sha256)
