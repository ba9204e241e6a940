import random
from hashlib import sha256

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from foliomill.llm import bpe, tokencount  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n\t", "Hello World's re-entry, we'll 123 ½ ² Ⅷ", "ΣΑΣ ΟΔΟΣ", "İstanbul I", "é äx", "a\x1cb\x1f c\x85d　e", "<|endoftext|> foo<|startoftext|>Bar <|endoftext", "emoji 🦩🦩 x", "a_b__c", "漢字かな 12", " x", "x" * 700, "ab" * 500 + " " + "'s't", "don't DON'T 'LL"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def random_texts(n, seed=3):
    r = random.Random(seed)
    pool = list("abcdeéñßÉ  \n\t.,'!$%19²漢🦩_-") + ["the ", "ing", "'s", "<|endoftext|>", "́", "Σ", "\x1d"]
    return ["".join(r.choices(pool, k=r.randrange(0, 300))) for _ in range(n)]


def test_encoding_and_decoding_equal_the_library(library):
    ours = bpe.load(PATH)
    for text in ODD + random_texts(400):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert ours.encode(text) == ids, repr(text)
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_arrays_and_heap_agree():
    ours, r = bpe.load(PATH), random.Random(5)
    pieces = ["".join(r.choices("etaoinshré", k=r.randrange(1, 120))) for _ in range(400)]
    for piece, got in zip(pieces, ours.parts(pieces)):
        ids = [ours.inner[b] for b in piece.encode()]
        ids[-1] = ours.last[piece.encode()[-1]]
        assert got == ours.heaped(ids)


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    ours = bpe.Bpe(PATH)
    cache = bpe.Cache(ours, tuple)
    for text in random_texts(60, seed=8):
        ids = [i for word in cache.of([bpe.words_of(text)])[0] for i in word]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert ours.decode_digits([" ".join(map(str, w)) for w in cache.of([bpe.words_of(text)])[0]]) == library.decode(ids, skip_special_tokens=False)


def test_encoded_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (0, "again", None)]
    out = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, keep_text=True).collect()
    want = {(i, t or ""): library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    assert len(out) == len(rows)
    by = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in out))
    assert by == sorted((i if i is not None else -1, len(x), tuple(x), sha256(" ".join(map(str, x)).encode()).hexdigest(), sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in want.items())
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(7, 1), (16, 4), (64, 8), (200, 50)])
def test_chunks_are_spliced_exactly(library, chunk, overlap):
    ours = bpe.load(PATH)
    for text in [t for t in ODD if t] + random_texts(120, seed=chunk):
        assert tokencount.count(text, ours.words, chunk, overlap) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_counted_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD + random_texts(40) + ["word and more, " * 4000])]
    out = {r.doc_id: r for r in tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, chunk=500, overlap=40).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_every_code_point_equals_the_library(library):
    ours, r = bpe.load(PATH), random.Random(8)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for first in range(0, len(points), 64):  # each between two letters, many in one text
        text = " ".join(f"a{chr(c)}b" for c in points[first : first + 64])
        assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids
    for _ in range(2000):
        text = "".join(chr(r.choice(points)) if r.random() < 0.7 else r.choice("aB' 9̣́") for _ in range(r.randrange(1, 12)))
        assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids, ascii(text)
