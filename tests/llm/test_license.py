import random

from foliomill.llm import license as lic


def test_templates_are_found_and_other_text_is_not(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices(["the", "ing", "er", "on", "ti"], k=r.randrange(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randrange(5, 30))).capitalize() + "."
    rows, want = [], {}
    for family, some in lic.TEMPLATES.items():
        for t in some:
            rows.append((len(rows), "\n".join([prose(), t + ".", prose()]), family))
            want[len(rows) - 1] = family
    wrapped = "Permission to use, copy, modify, and/or distribute\nthis software for any purpose with\nor without fee is hereby granted"
    rows.append((500, prose() + "\n" + wrapped + "\n" + prose(), "ISC"))
    want[500] = "ISC"
    rows += [(600 + i, "\n".join([prose(), t, prose()]), None) for i, t in enumerate(lic.OTHERS)]
    rows += [(700, None, None), (701, "", None), (702, "\n\n", None), (None, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", None), (0, rows[0][1], None)]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, family string, score double")
    out = lic.scan(docs, lic.fit(docs)).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    wrong = {d: (f, got[d].family) for d, f in want.items() if got[d].family != f}
    assert not wrong and all(got[d].n_licensed == 1 and got[d].similarity == 1 and got[d].score > 0.5 for d in want)
    assert all(got[600 + i].family == "unknown" and got[600 + i].n_licensed == 0 for i in range(len(lic.OTHERS)))
    assert [got[d].family for d in (700, 701, 702)] == ["unknown"] * 3 and got[700].n_paragraphs == 0
    assert got[None].families == "CC-BY-NC|MIT" and got[None].n_licensed == 2
    empty = docs.limit(0)
    assert lic.scan(empty, lic.fit(empty)).count() == 0


def test_lines_wrapped_before_a_capital_are_joined(spark):
    prose = "The ering onti the tion goes on\nInteron the erting is on the tier"
    rows = [
        (1, f"{prose}.\nLicensed under the Apache License,\nVersion 2.0\n{prose}"), (2, f"{prose}\nThis work is licensed under the GNU\nGeneral Public License, version 3\n{prose}"),
        (3, "Released under the MIT License\nLicensed under CC BY-NC 4.0"), (4, f"{prose}\nPermission to land\nHereby Granted"), (5, "x" * 200_000 + "\nAll rights reserved\n" + "y " * 100_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan(docs, lic.fit(docs)).collect()}
    assert [got[i].families for i in range(1, 6)] == ["Apache-2.0", "GPL", "CC-BY-NC|MIT", "", "Proprietary"] and [got[i].n_licensed for i in range(1, 6)] == [1, 1, 2, 0, 1]


def test_predictions_equal_a_plain_sum():
    import numpy as np

    model = lic.train(["the tion goes on in the ering", "another one of these"])
    for t in ("Licensed under the MIT License", "the driver lost his license", "words that nobody knows", ""):
        words = lic.words_of(t)
        z = np.array([model.weights[-1, c] + sum(model.weights[model.columns[x], c] for x in {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))} if x in model.columns) for c in range(len(model.families))], float) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family, score = model.predict(words)
        assert family == model.families[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_a_changed_template_is_confirmed_by_its_share():
    words = lic.words_of("This work is licensed under the GNU General Public License version 3")
    assert lic.similarity(words, "GPL") == 1
    assert lic.similarity(words[:6], "GPL") < lic.CONFIRMED


def test_licence_lines_of_the_documents_are_found(spark):
    lines = {"All rights reserved.": "Proprietary", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    prose = ["The ering onti the tion goes on.", "Interon the erting is on the tier."]
    rows = [(i, "\n".join([prose[0], line, prose[1]])) for i, line in enumerate(lines)] + [(100 + i, line) for i, line in enumerate(lines)]
    rows += [(200 + i, f"{prose[i % 2]} And {i} more ertings are on the way.") for i in range(50)] + [(300, "All rights of the reserved seats are gone.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan(docs, lic.fit(docs)).collect()}
    assert [got[n + i].family for n in (0, 100) for i in range(len(lines))] == [*lines.values()] * 2
    assert all(got[n + i].n_licensed == 1 for n in (0, 100) for i in range(len(lines)))
    assert got[300].family == "unknown" and all(got[200 + i].n_licensed == 0 for i in range(50))
