import random
from hashlib import sha256

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from test_simhash import brute as linked  # noqa: E402
from test_simhash import plain_fingerprint  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choices(["the", "ing", "er", "on", "ti", "an"], k=r.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, item = prose(80), prose(25)
    docs, labels = {}, []
    for i in range(260):
        text, toxic = prose(r.randrange(40, 120)), i % 4 == 0
        if toxic:
            text = " scoundrel blockhead ".join([text[:60], text[60:140], text[140:]])
        elif i % 10 == 1:
            text += " " + shared + " " + prose(10)
        elif i % 26 == 2:
            text = prose(30) + " " + item + " " + prose(30)
        docs[i] = text
        labels.append((i, 0, int(toxic)))
    for i in range(300, 312):  # exact and near copies of clean documents
        docs[i] = docs[(i - 300) * 4 + 3] + (" end" if i % 2 else "")
    return docs, labels, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, item = corpus()
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_equal_plain_versions(spark, folder, tmp_path):
    docs, labels, item = corpus()
    toxic = {i for i, _, t in labels if t}
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, folder).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(rows)
        assert k == 4 or rows.columns == COLUMNS
    texts = [{r.doc_id: r.text for r in o.collect()} for o in outs[:4]]
    assert set(texts[0]) == set(docs) - toxic
    of = linked([plain_fingerprint(docs[i]) for i in texts[0]])
    first = {}
    for i in sorted(texts[0]):
        first.setdefault(of[plain_fingerprint(docs[i])], i)
    assert set(texts[1]) == set(first.values()) and len(texts[1]) < len(texts[0])
    raws = {i: t.encode() for i, t in texts[1].items()}
    seen = {}
    for r in raws.values():
        for p in range(len(r) - 199):
            seen[r[p : p + 200]] = seen.get(r[p : p + 200], 0) + 1
    for i, r in raws.items():
        gone = bytearray(len(r))
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        assert texts[2][i] == bytes(b for b, g in zip(r, gone) if not g).decode()
    assert sum(map(len, texts[2].values())) < sum(map(len, texts[1].values()))
    assert set(texts[3]) == {i for i, t in texts[2].items() if item not in t} and len(texts[3]) < len(texts[2])
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = {r.doc_id: r for r in outs[4].collect()}
    assert set(last) == set(texts[3])
    for i, t in texts[3].items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(last[i].ids) == ids and last[i].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {i: r.ids_sha256 for i, r in last.items()}


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    text = " ".join(f"w{i % 7}x{i}" for i in range(60))
    other = " ".join(f"v{i % 5}y{i}" for i in range(60))
    rows = [(1, text), (1, other), (1, text), (None, "a text without an id that is like no other one here"), (None, None), (2, None), (3, ""), (None, "another text without an id that is unlike the first one, and so on")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, text), (1, other), rows[3], rows[7], (2, None)], key=str)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in out), key=str) == [1, 1, 2, None, None]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
