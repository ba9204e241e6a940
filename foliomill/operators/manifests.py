"""Policies, manifests, frozen runs and evidence of an evaluation, strictly read; and comparisons of outcomes with recordings.

Small documents, one at a time, in plain Python; `items` gives a manifest as a table for the checks across items.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What a policy and a manifest may say.
SPLITS, FORMATS = ("tuning", "holdout"), ("pdf_page", "image", "docx", "pptx")
METRICS = ("native_text_accuracy", "scanned_text_accuracy", "native_table_cell_accuracy", "visual_table_cell_accuracy", "visual_content_recall", "visual_content_precision", "native_visual_call_rate")
FLAGS = ("inspected", "used_for_threshold_calibration", "used_for_prompt_or_code_tuning")
#: What makes two runs the same.
IDENTITY = ("evaluator_version", "candidate_commit", "package_version", "policy_digest", "manifest_digest", "model_identity", "environment_identity", "replay_identity")
SHA256, COMMIT = re.compile(r"[0-9a-f]{64}"), re.compile(r"[0-9a-f]{40}")
ITEM = "item_id string, format string, split string, category string, source_id string, source_sha256 string, content_sha256 string, page_number int, contaminated boolean, real_document boolean"


class Invalid(ValueError):
    """A document that is not what it must be."""


def need(ok: object, what: str) -> None:
    if not ok:
        raise Invalid(what)


def fields(value: object, names: tuple[str, ...], what: str, optional: tuple[str, ...] = ()) -> dict:
    """An object with exactly these fields."""
    need(isinstance(value, dict), f"{what} is no object")
    need(set(names) <= set(value) <= {*names, *optional}, f"{what} has unknown or missing fields")
    return value


def whole(value: object, least: int, what: str) -> int:
    need(isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{what} is no whole number from {least}")
    return value


def words(value: object, what: str) -> str:
    need(isinstance(value, str) and value.strip(), f"{what} is no text")
    return value


def digest_text(value: object, what: str) -> str:
    need(isinstance(value, str) and SHA256.fullmatch(value), f"{what} is no SHA-256")
    return value


def canonical_digest(value: object) -> str:
    """SHA-256 of a JSON value, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def loaded(path: str | Path) -> object:
    """A JSON file; repeated keys and numbers that are none are refused."""

    def once(pairs):
        out = dict(pairs)
        need(len(out) == len(pairs), "a key repeats")
        return out

    def refuse(name):
        raise Invalid(f"{name} is no number")

    try:
        return json.loads(Path(path).read_text("utf-8"), object_pairs_hook=once, parse_constant=refuse)
    except (OSError, UnicodeDecodeError, json.JSONDecodeError) as e:
        raise Invalid("the file cannot be read as JSON") from e


def policy(value: object) -> dict:
    """A checked policy, with its digest."""
    p = fields(value, ("schema_version", "policy_version", "categories", "split_requirements", "quality"), "policy")
    need(p["schema_version"] == 1 and not isinstance(p["schema_version"], bool), "the policy's schema is unknown")
    words(p["policy_version"], "policy_version")
    need(isinstance(p["categories"], list) and p["categories"] and len({words(c, "a category") for c in p["categories"]}) == len(p["categories"]), "categories repeat")
    for name, n in fields(p["split_requirements"], ("pdf_image_items_per_split", "minimum_per_category", "office_documents_per_format"), "split_requirements").items():
        whole(n, 1, name)
    quality = fields(p["quality"], ("unresolved_handling", "metrics"), "quality")
    need(quality["unresolved_handling"] in ("fail", "disclose"), "unresolved_handling is unknown")
    need(isinstance(quality["metrics"], dict) and set(quality["metrics"]) == set(METRICS), "metrics are unknown or missing")
    for name, t in quality["metrics"].items():
        need(isinstance(t, dict) and len(t) == 1 and set(t) <= {"minimum", "maximum"}, f"{name} has no single threshold")
        need(all(isinstance(x, int | float) and not isinstance(x, bool) and 0 <= x <= 1 for x in t.values()), f"the threshold of {name} is no ratio")
    return p | {"digest": canonical_digest(value)}


def item(value: object, categories: list[str]) -> dict:
    """A checked item of a manifest as a row of ITEM; a holdout that was looked at is refused."""
    i = fields(value, ("item_id", "format", "split", "source", "content_sha256", "annotation", "contamination", "real_document"), "item", ("category", "page_number"))
    need(i["format"] in FORMATS and i["split"] in SPLITS, "format or split of an item is unknown")
    paged = i["format"] in ("pdf_page", "image")
    need((i.get("category") in categories) if paged else i.get("category") is None, "the category of an item is wrong")
    if i.get("page_number") is not None:
        whole(i["page_number"], 1, "page_number")
    source = fields(i["source"], ("source_id", "sha256", "path"), "source")
    need(words(source["path"], "path") and not Path(source["path"]).is_absolute() and ".." not in Path(source["path"]).parts, "the path of a source leaves its folder")
    note = fields(i["annotation"], ("ref", "sha256"), "annotation")
    words(note["ref"], "ref"), digest_text(note["sha256"], "the annotation's sha256")
    flags = fields(i["contamination"], FLAGS, "contamination")
    need(all(isinstance(f, bool) for f in flags.values()) and isinstance(i["real_document"], bool), "flags of an item are no booleans")
    need(not (i["split"] == "holdout" and any(flags.values())), "a holdout item was looked at")
    return {
        "item_id": words(i["item_id"], "item_id"), "format": i["format"], "split": i["split"], "category": i.get("category"), "source_id": words(source["source_id"], "source_id"), "source_sha256": digest_text(source["sha256"], "the source's sha256"),
        "content_sha256": digest_text(i["content_sha256"], "content_sha256"), "page_number": i.get("page_number"), "contaminated": any(flags.values()), "real_document": i["real_document"],
    }


def manifest(value: object, checked: dict) -> list[dict]:
    """The items of a manifest, as a whole in keeping with a policy: ids are unique, no content or source lies in two splits, and
    each split has what the policy asks for."""
    m = fields(value, ("schema_version", "policy_version", "items"), "manifest")
    need(m["schema_version"] == 1, "the manifest's schema is unknown")
    need(m["policy_version"] == checked["policy_version"], "the manifest is of another policy")
    need(isinstance(m["items"], list) and m["items"], "the manifest has no items")
    rows = [item(x, checked["categories"]) for x in m["items"]]
    need(len({r["item_id"] for r in rows}) == len(rows), "item ids repeat")
    for key in ("content_sha256", "source_id", "source_sha256"):
        of: dict[str, set[str]] = {}
        for r in rows:
            of.setdefault(r[key], set()).add(r["split"])
        need(all(len(s) == 1 for s in of.values()), f"a {key} lies in two splits")
    asked = checked["split_requirements"]
    for split in SPLITS:
        own = [r for r in rows if r["split"] == split]
        pages = [r for r in own if r["format"] in ("pdf_page", "image")]
        need(len(pages) == asked["pdf_image_items_per_split"], f"{split} has a wrong number of pages")
        for c in checked["categories"]:
            need(sum(r["category"] == c for r in pages) >= asked["minimum_per_category"], f"{split} has too few of {c}")
        for f in ("docx", "pptx"):
            need(sum(r["format"] == f for r in own) == asked["office_documents_per_format"], f"{split} has a wrong number of {f}")
    return rows


def items(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEM.split(", ")) for r in rows], ITEM)


def verified(rows: list[dict], paths: dict[str, str], root: str | Path) -> None:
    """Whether the sources of a manifest (item_id -> path) lie below a folder and have the digests it says."""
    base = Path(root).resolve()
    for r in rows:
        at = (base / paths[r["item_id"]]).resolve()
        need(at.is_relative_to(base) and at.is_file(), "a source is not in its folder")
        need(sha256_file(at) == r["source_sha256"], "a source is not what the manifest says")


def as_tuning(value: dict, **seen: bool) -> dict:
    """An item moved to the tuning split; flags once set stay."""
    need(set(seen) <= set(FLAGS), "a flag is unknown")
    return value | {"split": "tuning", "contamination": {f: bool(value["contamination"][f] or seen.get(f, False)) for f in FLAGS}}


def workspace(path: str | Path, runs: str | Path) -> Path:
    """A run's folder, which must lie below the folder of runs."""
    at = Path(path).resolve()
    need(at.is_relative_to(Path(runs).resolve()), "the run's folder is not below the folder of runs")
    return at


def identity(record: dict) -> dict:
    need(all(isinstance(record.get(k), str) and record[k] for k in IDENTITY if k != "replay_identity"), "the identity of a run is incomplete")
    return {k: record.get(k) for k in IDENTITY}


def freeze(record: dict) -> dict:
    """What is kept of a tuning run that passed, so that the holdout is run once, with the same things."""
    need(record.get("split") == "tuning" and record.get("passed") is True, "only a tuning run that passed can be frozen")
    frozen = {"schema_version": 1, "identity": identity(record), "record_digest": canonical_digest(record)}
    return frozen | {"freeze_digest": canonical_digest(frozen)}


def may_run_holdout(frozen: dict, wanted: dict) -> dict:
    """The freeze, if it is whole and of the same identity as the run that is wanted."""
    f = fields(frozen, ("schema_version", "identity", "record_digest", "freeze_digest"), "freeze")
    need(canonical_digest({k: v for k, v in f.items() if k != "freeze_digest"}) == f["freeze_digest"], "the freeze was changed")
    need(f["identity"] == identity(wanted), "the run is not the one that was frozen")
    return f


def cached(record: dict, wanted: dict, split: str) -> dict:
    """A record kept from before, if it is of the wanted run and split."""
    need(record.get("split") == split, "the record is of another split")
    for k in IDENTITY:
        need(record.get(k) == wanted.get(k), f"the record is of another {k}")
    return record


def summary(report: dict) -> str:
    """A report (passed, policy_version, policy_digest, candidate_commit, split, metrics: name, value, unresolved, passed) in lines."""
    word = lambda ok: "PASS" if ok else "FAIL"
    lines = [f"Document quality: {word(report['passed'])}", f"Policy: {report['policy_version']} ({report['policy_digest']})", f"Candidate: {report['candidate_commit']}", f"Split: {report['split']}"]
    lines += [f"- {m['name']}: {'unresolved' if m['value'] is None else format(m['value'], '.4f')}; unresolved={m['unresolved']}; {word(m['passed'])}" for m in report["metrics"]]
    return "\n".join(lines)


def evidence(quality: list[dict], resources: dict | None = None) -> str:
    """Evidence for a release as Markdown: quality records of both splits, all passed and of one identity; resources if there are."""
    need({r.get("split") for r in quality} == set(SPLITS) and len(quality) == 2, "evidence needs a record of each split")
    need(all(r.get("passed") is True for r in quality), "evidence takes only records that passed")
    need(identity(quality[0]) == identity(quality[1]), "the records are of different runs")
    one = identity(quality[0])
    need(COMMIT.fullmatch(one["candidate_commit"]) and SHA256.fullmatch(one["policy_digest"]) and SHA256.fullmatch(one["manifest_digest"]), "digests of the records are not valid")
    lines = ["# Release evidence", "", *(f"- {k.replace('_', ' ').capitalize()}: `{one[k]}`" for k in IDENTITY if one[k])]
    for r in sorted(quality, key=lambda r: SPLITS.index(r["split"])):
        lines += ["", f"## {r['split'].capitalize()}", "", "| Metric | Value | Passed |", "| --- | --- | --- |"]
        for m in r["metrics"]:
            need(m["value"] is None or 0 <= m["value"] <= 1, "a value is no ratio")
            lines.append(f"| {m['name']} | {'unresolved' if m['value'] is None else format(m['value'], '.4f')} | {'yes' if m['passed'] else 'no'} |")
    if resources:
        need(all(isinstance(v, int | float) and v >= 0 for v in resources.values()), "resources are no numbers")
        lines += ["", "## Resources", "", *(f"- {k.replace('_', ' ')}: {v:g}" for k, v in sorted(resources.items()))]
    return "\n".join(lines) + "\n"


def checklist(value: object) -> dict:
    """An approved checklist of one document: its digest, anchors in order, tables at least, warnings that may be."""
    c = fields(value, ("asset_sha256", "approved", "anchors", "minimum_tables", "allowed_warnings"), "checklist")
    digest_text(c["asset_sha256"], "asset_sha256"), whole(c["minimum_tables"], 0, "minimum_tables")
    need(c["approved"] is True, "the checklist is not approved")
    need(isinstance(c["anchors"], list) and c["anchors"] and all(SHA256.fullmatch(a) for a in c["anchors"]), "anchors are no digests")
    return c


def candidate(asset: bytes, markdown: str, warnings: list[str]) -> dict:
    """A checklist to be looked at by a person; it is never approved by itself."""
    return {"asset_sha256": hashlib.sha256(asset).hexdigest(), "approved": False, "anchors": anchors(markdown), "minimum_tables": 0, "allowed_warnings": sorted(set(warnings))}


def anchors(markdown: str) -> list[str]:
    """SHA-256 of each stripped line that is not blank."""
    return [hashlib.sha256(x.strip().encode()).hexdigest() for x in markdown.splitlines() if x.strip()]


def replay(value: object, asset: bytes) -> dict:
    """A recording (requests' digests with their answers, warnings, the Markdown's digest) of the document at hand."""
    r = fields(value, ("asset_sha256", "requests", "warnings", "markdown_sha256"), "replay")
    need(r["asset_sha256"] == hashlib.sha256(asset).hexdigest(), "the recording is of another document")
    need(isinstance(r["requests"], list) and all(set(x) == {"digest", "answer"} for x in r["requests"]), "requests are not valid")
    return r


def same_as_replay(recorded: dict, markdown: str, warnings: list[str], asked: list[str]) -> None:
    """Whether an outcome is the recorded one, requests in the same order."""
    need(asked == [x["digest"] for x in recorded["requests"]], "other requests were made")
    need(warnings == recorded["warnings"], "other warnings were given")
    need(hashlib.sha256(markdown.encode()).hexdigest() == recorded["markdown_sha256"], "the Markdown differs")


def live_structure(approved: dict, markdown: str, warnings: list[str], calls: int, budget: int) -> None:
    """Whether a live outcome has the approved anchors in order, no warning beside the allowed ones, and few enough calls."""
    rest = iter(anchors(markdown))
    need(all(a in rest for a in approved["anchors"]), "anchors are missing or out of order")
    need({w.split(":")[0] for w in warnings} <= set(approved["allowed_warnings"]), "a warning is not allowed")
    need(calls <= budget, "too many calls were made")
