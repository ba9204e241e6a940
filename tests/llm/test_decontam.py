import random

from foliomill.llm import decontam


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, item_id int, hash string")


ITEM = "Tom has 3 apples and gives Anna 2 of them, so how many apples does Tom have left after 5 days without 3 more?"


def test_copies_and_new_parameters_are_caught(spark):
    bench = spark.createDataFrame([(1, ITEM, "t"), (2, "Too short 5 kg", "t"), (3, "A B C D E F G H I J", "t"), (4, None, "t"), (None, "the quick brown fox jumps over the lazy dog again", "t"), (1, ITEM, "t")], "item_id long, text string, tokens string")
    rows = [
        (1, "Intro words here. " + ITEM + " And an end."),
        (2, "x " + ITEM.replace("Tom", "Bob").replace("Anna", "Eve").replace("3", "7").replace("2", "4").replace("5", "9")),
        (3, ITEM.replace("Tom", "Bob", 1).replace("3", "7", 1)),  # the same name and number stand for two values
        (4, "Nothing of the kind is in this text, it has other words altogether, and many of them."),
        (5, None), (6, ""), (7, "A B C D E F G H I J"), (8, "K L M N O P Q R S T U V W X"), (9, "we say too Short 6 mg"),
        (None, "see the quick brown fox jumps over the lazy dog again, then stop"), (1, "Intro words here. " + ITEM + " And an end."),
    ]
    got = decontam.leaks(docs_of(spark, rows), bench).collect()
    found = sorted(((r.doc_id, r.item_id, r.exact) for r in got), key=str)
    assert found == sorted([(1, 1, True), (2, 1, False), (7, 3, True), (None, None, True)], key=str)
    kept = decontam.clean(docs_of(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "item_id", "hash"]
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 8, 9}
    assert decontam.leaks(docs_of(spark, rows).limit(0), bench).count() == 0
    assert decontam.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_half_a_passage_is_enough(spark):
    r = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    item = " ".join(r.choices(words, k=60))
    noise = lambda: " ".join(r.choices(words, k=40))
    part = lambda n: " ".join(item.split()[:n])
    rows = [(0, f"{noise()} {part(40)} {noise()}"), (1, f"{noise()} {part(20)} {noise()}"), (2, noise())]
    got = decontam.leaks(docs_of(spark, rows), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_windows, r.n_matched) for r in got] == [(0, 53, 33)]


def test_templates_of_texts_are_those_of_their_tokens(spark):
    from pyspark.sql import functions as F

    texts = [ITEM, "iPhone 5kg 3,5 km/h McDonald ÉTÉ été 7.8.9 $5 5% A1 İx ǅ a1b2 KG Km 2nd", "", "Σ ß ÄÖ x́Y", "𝐀𝐁 𝐜 𝐀5 ⅅ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(decontam.templates(F.col("t")).alias("a"), F.transform(decontam.tokens(F.col("t")), decontam.template).alias("b")).collect():
        assert r.a == r.b


def test_copies_whose_case_was_changed_are_caught(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    other = "The Mayor Of Rome And The Queen Of Spain Met In May To Sign A Treaty On The Fish Of The Sea"
    rows = [(1, ITEM.upper()), (2, "so they say: " + ITEM.lower() + " and no more"), (3, ITEM.title()), (4, ITEM), (5, other.upper()), (6, other)]
    docs = docs_of(spark, rows)
    assert sorted((r.doc_id, r.item_id, r.exact) for r in decontam.leaks(docs, bench).collect()) == [(i, 1, True) for i in (1, 2, 3, 4)]
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {5, 6}
