import random
import zlib

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from foliomill.llm import langid, ngrams, toxicity  # noqa: E402

SYLLABLES = {"en": "the ing and tion ent er on".split(), "de": "sch ung heit ein der über keit".split(), "es": "ción mente que los ar ñ do".split()}


def texts(n, seed=1):
    r = random.Random(seed)
    word = lambda lang: "".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4)))
    rows = []
    for i in range(n):
        lang = r.choices(["en", "de", "es"], [6, 2, 1])[0]
        rows.append((i, " ".join(word(lang).title() if r.random() < 0.1 else word(lang) for _ in range(r.randrange(5, 60))), lang))
    return rows


def held(i, parts, rest):
    return zlib.crc32(str(i).encode()) % parts == rest


def test_ngrams_belong_to_their_text_alone():
    some = ["abc", "", "ABC xyz", "ñ"]
    alone = [[sorted(b.tolist()) for _, b in ngrams.grams([t], (1, 2, 3), 1 << 10)] for t in some]
    for k, (number, bucket) in enumerate(ngrams.grams(some, (1, 2, 3), 1 << 10)):
        for i in range(len(some)):
            assert sorted(bucket[number == i].tolist()) == alone[i][k]
    assert [b.tolist() for _, b in ngrams.grams(["AbC"], (2,), 64)] == [b.tolist() for _, b in ngrams.grams(["aBc"], (2,), 64)]


def test_languages_are_learned(spark):
    rows = [(*x, "s", 0.5) for x in texts(400)]
    rows += [(1000, None, "en", "s", 0.5), (1001, "", "de", "s", 0.5), (1002, "12 34 !!", "en", None, 0.5), (None, "the and the", None, "s", 0.5), (7, rows[7][1], None, "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    out = langid.predict(docs, langid.fit(docs, sample=150)).collect()
    assert len(out) == len(rows)
    lang = {r[0]: r[2] for r in rows[:400]}
    tested = [r for r in out if r.doc_id in lang and r.held_out]
    assert len(tested) > 60 and np.mean([r.lang_pred == lang[r.doc_id] for r in tested]) > 0.95
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 4, 2)) and 0 <= r.score <= 1 for r in out)
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}


def test_nothing_to_learn_languages_from(spark):
    docs = spark.createDataFrame([(1, "word", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"und"}
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0


def test_ftrl_is_sparse_and_calibrated():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 300)
    rows = [(np.array([k, 3 + r.integers(0, 40), 43]), np.ones(3, np.float32)) for k in y]
    w = langid.ftrl(rows, y, 44, 3, l1=1.5)
    assert (w == 0).mean() > 0.3
    assert np.mean([np.argmax(x @ w[at]) == k for (at, x), k in zip(rows, y)]) > 0.98
    sharp = np.where(np.eye(3)[r.integers(0, 3, 200)] > 0, 9.0, 0.0)
    assert langid.temperature(sharp, np.where(r.random(200) < 0.7, sharp.argmax(axis=1), r.integers(0, 3, 200))) > 1.5


def test_toxicity_is_learned(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i, text, lang in texts(600, seed=2):
        words, toxic = text.split(), r.random() < 0.2
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["Scoundrel", "rascals", "blockhead"]))
        docs.append((i, " ".join(words), lang, "p"))
        if i % 3:
            labels.append((i, int(toxic), "p"))
    truth = dict((i, y) for i, y, _ in labels)
    docs += [(900, None, None, "p"), (901, "", "en", None), (None, "rascals here", "en", "p"), (5, docs[5][1], "en", "p")]
    labels += [(900, None, "p"), (None, 1, "p"), (77777, 1, "p"), (4, 7, "p"), (truth and 5, truth.get(5, 0), "p")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, predicted string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(d, lab)
    out = toxicity.score(d, model).collect()
    assert len(out) == len(docs)
    tested = [x for x in out if x.doc_id in truth and x.held_out]
    assert len(tested) > 50 and np.mean([x.predicted == truth[x.doc_id] for x in tested]) > 0.95
    assert all(x.predicted == (x.score >= 0.5) and 0 <= x.score <= 1 and x.held_out == (x.doc_id is not None and held(x.doc_id, 5, 0)) for x in out)
    kept = toxicity.accepted(d, model)
    assert kept.columns == d.columns and kept.count() == sum(x.predicted == 0 for x in out)


@pytest.mark.parametrize("marks,want", [([(1, 1), (2, 1)], 1), ([(1, 0), (2, 0)], 0), ([], 0)])
def test_one_class_or_none(spark, marks, want):
    d = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {x.predicted for x in toxicity.score(d, model).collect()} == {want}
    assert toxicity.score(d.limit(0), model).count() == 0


def plain_language(text, model):
    """lang and score of a text by plain counting of its hashed n-grams."""
    from collections import Counter

    tf = Counter(int(b) for _, bucket in ngrams.grams([text], langid.SIZES, langid.DIMS) for b in bucket)
    x = {b: np.log1p(n) * float(model.idf[b]) for b, n in tf.items()}
    size = max(np.sqrt(sum(v * v for v in x.values())), 1e-9)
    z = np.array([float(model.weights[-1, c]) + sum(v / size * float(model.weights[b, c]) for b, v in x.items()) for c in range(len(model.langs))]) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.langs[int(p.argmax())], float(p.max())


def test_language_scores_equal_a_plain_sum(spark):
    rows = [*texts(200, seed=9), (500, "der die " * 20_000, "de"), (501, "x", None), (502, "Ωμέγα ß", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=90)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text, _ in rows[::9] + rows[-3:]:
        lang, score = plain_language(text, model)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3


def test_only_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "CLASSES", 2)
    docs = spark.createDataFrame(texts(300), "doc_id long, text string, lang string")
    assert langid.fit(docs, sample=60).langs == ["de", "en"]


def test_toxicity_scores_equal_a_plain_sum(spark):
    rows = [(i, t + (" rascals" if i % 5 == 1 else ""), "x") for i, t, _ in texts(200, seed=3)] + [(900, "scoundrel " * 20_000, "x"), (901, None, "x"), (902, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(200)] + [(1, 0)], "doc_id long, toxic int")  # two labels: the larger counts
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows[::11] + rows[-3:]:
        buckets = {int(b) for _, bucket in ngrams.grams([text or ""], toxicity.SIZES, toxicity.DIMS) for b in bucket}
        z = model.bias + sum(float(model.weights[b]) for b in buckets)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6


def test_ratios_count_beyond_their_error_only():
    counts, seen = np.array([[50.0, 0, 5, 0], [5.0, 0, 50, 1]]), np.array([100, 100])
    r = toxicity.ratios(counts, seen)
    assert r[0] < -0.5 and r[2] > 0.5 and r[1] == 0 and r[3] == 0


def test_dual_descent_finds_the_least_loss():
    r = np.random.default_rng(1)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(80)]
    y = np.array([int(len(set(at) & {0, 1, 2}) > 1) for at in rows])
    scale, cost = r.normal(1, 0.3, 12), np.full(80, 0.5)
    w, b = toxicity.logistic(rows, y, scale, cost, epochs=500)
    x = np.zeros((80, 13))
    for i, at in enumerate(rows):
        x[i, at], x[i, 12] = scale[at], 1
    u, s = np.append(w, b), np.where(y == 1, 1.0, -1.0)
    gradient = u - x.T @ (cost * s / (1 + np.exp(s * (x @ u))))
    assert np.abs(gradient).max() < 0.02
