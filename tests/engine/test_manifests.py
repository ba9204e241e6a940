import hashlib

import pytest

from foliomill.operators import evaluate, manifests

HEX = lambda x: hashlib.sha256(str(x).encode()).hexdigest()
CATEGORIES = ["native_text", "mixed"]
POLICY = {"schema_version": 1, "policy_version": "t", "categories": CATEGORIES, "split_requirements": {"pdf_image_items_per_split": 2, "minimum_per_category": 1, "office_documents_per_format": 1}, "quality": {"unresolved_handling": "fail", "metrics": {m: {"minimum": 0.5} for m in manifests.METRICS}}}


def item(n, split, kind="pdf_page", category=None):
    return {"item_id": f"i{n}", "format": kind, "split": split, "category": category, "source": {"source_id": f"s{n}", "sha256": HEX(n), "path": f"a/{n}.{kind}"}, "content_sha256": HEX(("c", n)), "annotation": {"ref": "r", "sha256": HEX("a")}, "contamination": dict.fromkeys(manifests.FLAGS, False), "real_document": True}


def whole():
    rows = [item(10 * s + k, split, *spec) for s, split in enumerate(manifests.SPLITS) for k, spec in enumerate([("pdf_page", "native_text"), ("image", "mixed"), ("docx",), ("pptx",)])]
    return {"schema_version": 1, "policy_version": "t", "items": rows}


def test_policies_and_manifests(spark, tmp_path):
    checked = manifests.policy(POLICY)
    rows = manifests.manifest(whole(), checked)
    assert manifests.items(spark, rows).count() == 8 and evaluate.crossing(manifests.items(spark, rows), "content_sha256", "split").count() == 0
    assert checked["digest"] == manifests.canonical_digest(dict(reversed(POLICY.items())))
    for change in (lambda m: m["items"][0].update(extra=1), lambda m: m["items"].pop(), lambda m: m["items"][4].update(content_sha256=m["items"][0]["content_sha256"]), lambda m: m["items"][4]["contamination"].update(inspected=True), lambda m: m["items"][0]["source"].update(path="../x"), lambda m: m["items"][1].update(item_id="i0"), lambda m: m.update(policy_version="u")):
        bad = whole()
        change(bad)
        with pytest.raises(manifests.Invalid):
            manifests.manifest(bad, checked)
    for bad in ({**POLICY, "schema_version": 2}, {**POLICY, "categories": ["a", "a"]}, {**POLICY, "quality": {"unresolved_handling": "fail", "metrics": {}}}):
        with pytest.raises(manifests.Invalid):
            manifests.policy(bad)
    moved = manifests.as_tuning(whole()["items"][4], inspected=True)
    assert moved["split"] == "tuning" and moved["contamination"]["inspected"]
    (tmp_path / "x.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(manifests.Invalid):
        manifests.loaded(tmp_path / "x.json")
    (tmp_path / "a").write_bytes(b"0")
    one = [{"item_id": "i", "source_sha256": HEX("0")}]
    manifests.verified(one, {"i": "a"}, tmp_path)
    with pytest.raises(manifests.Invalid):
        manifests.verified(one, {"i": "../a"}, tmp_path)


RECORD = {"split": "tuning", "passed": True, "evaluator_version": "1", "candidate_commit": "a" * 40, "package_version": "1", "policy_digest": HEX("p"), "manifest_digest": HEX("m"), "model_identity": "x", "environment_identity": "e", "replay_identity": None, "policy_version": "t", "metrics": [{"name": "native_text_accuracy", "value": 0.98765, "unresolved": 0, "passed": True}, {"name": "visual_content_recall", "value": None, "unresolved": 2, "passed": False}]}


def test_freeze_evidence_and_summary():
    frozen = manifests.freeze(RECORD)
    assert manifests.may_run_holdout(frozen, {**RECORD, "split": "holdout"}) == frozen
    for bad, wanted in ((frozen | {"record_digest": HEX(1)}, RECORD), (frozen, {**RECORD, "model_identity": "y"})):
        with pytest.raises(manifests.Invalid):
            manifests.may_run_holdout(bad, wanted)
    with pytest.raises(manifests.Invalid):
        manifests.freeze({**RECORD, "passed": False})
    assert manifests.cached(RECORD, RECORD, "tuning") is RECORD
    text = manifests.evidence([{**RECORD, "split": "holdout"}, RECORD], {"peak_concurrency": 4})
    assert text.index("## Tuning") < text.index("## Holdout") and "| native_text_accuracy | 0.9877 | yes |" in text and "- peak concurrency: 4" in text
    for records in ([RECORD, RECORD], [RECORD, {**RECORD, "split": "holdout", "passed": False}], [RECORD, {**RECORD, "split": "holdout", "package_version": "2"}]):
        with pytest.raises(manifests.Invalid):
            manifests.evidence(records)
    assert manifests.summary(RECORD).splitlines()[-2:] == ["- native_text_accuracy: 0.9877; unresolved=0; PASS", "- visual_content_recall: unresolved; unresolved=2; FAIL"]


def test_checklists_and_replays():
    asset, md = b"doc", "# A\n\ntext\n"
    made = manifests.candidate(asset, md, ["w: x"])
    with pytest.raises(manifests.Invalid):
        manifests.checklist(made)
    approved = manifests.checklist(made | {"approved": True, "allowed_warnings": ["w"]})
    manifests.live_structure(approved, "# A\nmore\ntext", ["w: y"], 2, 2)
    for args in (("text\n# A", [], 1, 2), (md, ["v: y"], 1, 2), (md, [], 3, 2)):
        with pytest.raises(manifests.Invalid):
            manifests.live_structure(approved, *args)
    recorded = manifests.replay({"asset_sha256": hashlib.sha256(asset).hexdigest(), "requests": [{"digest": "d", "answer": "{}"}], "warnings": [], "markdown_sha256": hashlib.sha256(md.encode()).hexdigest()}, asset)
    manifests.same_as_replay(recorded, md, [], ["d"])
    for args in ((md, [], []), (md, ["w"], ["d"]), ("x", [], ["d"])):
        with pytest.raises(manifests.Invalid):
            manifests.same_as_replay(recorded, *args)
