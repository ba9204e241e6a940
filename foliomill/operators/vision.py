"""The seam to a vision model: a client is injected, its answers are checked, and each distinct image is asked for once."""

from __future__ import annotations

import base64
import json
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.operators import images as I
from foliomill.sources.package import Rejected

#: A client takes (image bytes, prompt) and gives the model's answer; it raises Transient for failures worth another try.
Client = Callable[[bytes, str], str]
#: Requests under way at once, further tries, longest wait between them (s), characters of an answer that is sent back
#: for repair, repeated lines that tiles may share, bytes of an image that is sent.
CONCURRENCY, RETRIES, WAIT, REPAIR_CHARS, SHARED_LINES, IMAGE_BYTES = 4, 2, 1.0, 10_000, 10, 12 << 20
ANSWER = "array<struct<type:string,text:string,grid:array<array<string>>,header_rows:int,source_index:int,bbox:array<double>>>"
PROMPT = "Transcribe everything that can be read in the image, in reading order, as JSON: {\"elements\": [...]}. An element is {\"type\": \"text\", \"text\", \"source_index\"} or {\"type\": \"table\", \"grid\", \"header_rows\", \"source_index\"}. Add nothing that is not there."
TABLE_PROMPT = PROMPT + " The image shows a table: give it as one, row by row."
REPAIR = "Rewrite this answer as valid JSON of the asked form, and change none of its words:"
#: Forms of answer that a model may be asked for, from the strictest on.
MODES = ("json_schema", "json_object", "text")
SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["elements"],
    "properties": {"elements": {"type": "array", "items": {"anyOf": [
        {"type": "object", "additionalProperties": False, "required": ["type", "text", "source_index"], "properties": {"type": {"const": "text"}, "text": {"type": "string"}, "source_index": {"type": "integer"}, "bbox": {"type": "array", "items": {"type": "number"}}}},
        {"type": "object", "additionalProperties": False, "required": ["type", "grid", "header_rows", "source_index"], "properties": {"type": {"const": "table"}, "grid": {"type": "array", "items": {"type": "array", "items": {"type": ["string", "null"]}}}, "header_rows": {"type": "integer"}, "source_index": {"type": "integer"}, "bbox": {"type": "array", "items": {"type": "number"}}}},
    ]}}},
}
#: What failures are called by providers, by kind.
FAILURES = {
    "transient": ("timeout", "ratelimit", "apiconnection", "serviceunavailable", "internalserver", "badgateway", "connection"),
    "configuration": ("authentication", "permission", "notfound", "invalidapikey"), "refused": ("contentpolicy", "contentfilter"), "unsupported_format": ("unsupportedparams", "responseformat"),
}


class Transient(Exception):
    """The model may answer if it is asked again."""


class UnsupportedForm(Exception):
    """The model cannot give the asked form of answer."""


def failure_kind(error: BaseException) -> str:
    """transient, configuration, refused, unsupported_format or failed, by the names of the error's classes and what it says."""
    if isinstance(error, Transient | TimeoutError | ConnectionError):
        return "transient"
    if isinstance(error, UnsupportedForm) or "response_format" in str(error):
        return "unsupported_format"
    names = [c.__name__.lower() for c in type(error).__mro__]
    return next((kind for kind, parts in FAILURES.items() if any(p in n for n in names for p in parts)), "failed")


class ChatClient:
    """A client over any chat completion function (request dict -> answer text). Starts with the strictest form of answer and goes
    on with the next one when the model cannot give it; what was found holds for later requests."""

    def __init__(self, complete: Callable[[dict], str], model: str, mode: str = MODES[0], timeout: float = 120.0):
        self.complete, self.model, self.mode, self.timeout = complete, model, mode, timeout

    def request(self, image: bytes, prompt: str) -> dict:
        if len(image) > IMAGE_BYTES:
            raise Rejected("limit_exceeded", "the image is too large to be sent")
        kind = I.header(image).format
        uri = f"data:image/{kind};base64,{base64.b64encode(image).decode()}"
        form = {"json_schema": {"type": "json_schema", "json_schema": {"name": "elements", "strict": True, "schema": SCHEMA}}, "json_object": {"type": "json_object"}}.get(self.mode)
        said = prompt if self.mode == "json_schema" else f"{prompt}\nAnswer with one JSON object and nothing else."
        content = [{"type": "text", "text": said}, {"type": "image_url", "image_url": {"url": uri}}]
        return {"model": self.model, "timeout": self.timeout, "messages": [{"role": "user", "content": content}]} | ({"response_format": form} if form else {})

    def __call__(self, image: bytes, prompt: str) -> str:
        while True:
            try:
                return self.complete(self.request(image, prompt))
            except Exception as e:
                kind = failure_kind(e)
                if kind == "unsupported_format" and self.mode != MODES[-1]:
                    self.mode = MODES[MODES.index(self.mode) + 1]
                elif kind == "transient":
                    raise Transient(str(e)) from e
                else:
                    raise


def parsed(answer: str) -> list[dict] | None:
    """Elements of an answer, in order of source_index; None if it keeps to no known form."""
    try:
        data = json.loads(answer)
    except ValueError:
        return None
    if isinstance(data, dict) and set(data) in ({"text"}, {"content"}):
        data = {"elements": [{"type": "text", "text": next(iter(data.values())), "source_index": 0}]}
    if not isinstance(data, dict) or set(data) != {"elements"} or not isinstance(data["elements"], list):
        return None
    out = []
    for e in data["elements"]:
        if not isinstance(e, dict) or not isinstance(e.get("source_index"), int) or isinstance(e["source_index"], bool):
            return None
        box = e.get("bbox")
        if box is not None and not (isinstance(box, list) and len(box) == 4 and all(isinstance(v, int | float) for v in box) and box[0] < box[2] and box[1] < box[3]):
            return None
        if e.get("type") == "text" and isinstance(e.get("text"), str):
            out.append({"type": "text", "text": e["text"], "grid": None, "header_rows": None, "source_index": e["source_index"], "bbox": box})
        elif e.get("type") == "table" and isinstance(e.get("grid"), list) and e["grid"] and all(isinstance(r, list) and len(r) == len(e["grid"][0]) for r in e["grid"]) and 0 <= (e.get("header_rows") or 0) <= len(e["grid"]):
            out.append({"type": "table", "text": None, "grid": [["" if c is None else str(c) for c in r] for r in e["grid"]], "header_rows": e.get("header_rows") or 0, "source_index": e["source_index"], "bbox": box})
        else:
            return None
    return sorted(out, key=lambda e: e["source_index"])


@dataclass
class Job:
    """A request and how it stands; `trace` tells what was done for it."""

    index: int
    image: bytes
    prompt: str
    needs_table: bool = False
    tries: int = 0
    repaired: bool = False
    elements: list[dict] | None = None
    error: str | None = None
    trace: list[str] = field(default_factory=list)


class Dispatcher:
    """Asks for many images with a bounded number of requests under way. A job that failed for now, or whose answer must be
    repaired, goes to the end of the line; results come in the order of the jobs. One job's failure is its own."""

    def __init__(self, client: Client, concurrency: int = CONCURRENCY, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep):
        self.client, self.concurrency, self.retries, self.sleep = client, concurrency, retries, sleep

    def attempt(self, job: Job) -> bool:
        """One try; whether the job must go to the end of the line."""
        try:
            answer = self.client(job.image, job.prompt)
        except Exception as e:
            kind = failure_kind(e)
            job.trace.append(kind)
            if kind == "transient" and job.tries < self.retries:
                self.sleep(min(0.1 * 2**job.tries, WAIT))
                job.tries += 1
                return True
            job.error = {"transient": "model_unavailable", "configuration": "model_configuration"}.get(kind, "vision_failed")
            return False
        found = parsed(answer)
        if found is not None and not (job.needs_table and not any(e["type"] == "table" for e in found)):
            job.elements = found
            job.trace.append("answered")
            return False
        job.trace.append("out of form")
        if job.repaired:
            job.error = "model_invalid_response"
            return False
        job.repaired, job.prompt = True, f"{job.prompt}\n{REPAIR}\n{answer[:REPAIR_CHARS]}"
        return True

    def run(self, jobs: list[Job]) -> list[Job]:
        waiting: queue.Queue[Job | None] = queue.Queue()
        left = threading.Semaphore(0)
        for job in jobs:
            waiting.put(job)

        def work() -> None:
            while (job := waiting.get()) is not None:
                if self.attempt(job):
                    waiting.put(job)
                else:
                    left.release()

        threads = [threading.Thread(target=work, daemon=True) for _ in range(min(self.concurrency, len(jobs)))]
        for t in threads:
            t.start()
        for _ in jobs:
            left.acquire()
        for _ in threads:
            waiting.put(None)
        for t in threads:
            t.join()
        return sorted(jobs, key=lambda j: j.index)


def ask(client: Client, image: bytes, prompt: str, retries: int = RETRIES) -> tuple[list[dict] | None, str | None]:
    """(elements, error) of one image: further tries for transient failures, one repair for an answer out of form."""
    job = Dispatcher(client, 1, retries, sleep=lambda _: None).run([Job(0, image, prompt)])[0]
    return job.elements, job.error


def told(client: Client, contents: list[bytes], prompt: str = PROMPT) -> list[tuple[list[dict] | None, str | None]]:
    """(elements, error) of each of some images: tall ones are asked for in tiles, very wide ones must give a table. Images that
    show nothing give no element; those that cannot be read here are sent as they are; a tile that fails leaves the others."""
    jobs: list[Job] = []
    parts: list[tuple[list[Job], list[tuple[int, int]], int]] = []
    for content in contents:
        try:
            ready = I.prepare(content)
            tiles, height, wide, skip = ready.tiles, ready.header.height, ready.header.width >= I.ULTRA_WIDE * ready.header.height, ready.skip
        except Rejected:
            tiles, height, wide, skip = [(content, 0, 1)], 1, False, False
        own = [] if skip else [Job(len(jobs) + k, image, I.tile_prompt(TABLE_PROMPT if wide else prompt, k, len(tiles)), wide) for k, (image, _, _) in enumerate(tiles)]
        jobs += own
        parts.append((own, [(a, b) for _, a, b in tiles], height))
    Dispatcher(client).run(jobs)
    out: list[tuple[list[dict] | None, str | None]] = []
    for own, ranges, height in parts:
        answers = [j.elements for j in own]
        errors = [j.error for j in own if j.error]
        if own and all(a is None for a in answers):
            out.append((None, errors[0]))
        elif len(own) == 1:
            out.append((answers[0], None))
        else:
            out.append((I.merged_tiles(answers, ranges, height, without_overlap), f"tile_failed: {errors[0]}" if errors else None))
    return out


def outcomes(images: DataFrame, client: Client, prompt: str = PROMPT) -> DataFrame:
    """digest, elements, error: each distinct digest of `images` (digest, content) is asked for once. A task has up to
    `CONCURRENCY` requests under way; repartition the images to bound how many tasks ask at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), 64):
                some = frame.iloc[first : first + 64]
                got = told(client, [bytes(c) for c in some["content"]], prompt)
                yield pd.DataFrame({"digest": some["digest"].to_numpy(), "elements": [g[0] for g in got], "error": [g[1] for g in got]})

    once = images.groupBy("digest").agg(F.first("content").alias("content"))
    return once.mapInPandas(run, f"digest string, elements {ANSWER}, error string")


def answer_elements(answer: Column) -> Column:
    """Elements of a column of answers, checked and ordered by `parsed`; null where an answer is out of form."""

    @F.pandas_udf(ANSWER)
    def of(answers: pd.Series) -> pd.Series:
        return answers.map(lambda a: parsed(a) if a is not None else None)

    return of(answer)


def without_overlap(before: str, after: str) -> str:
    """The text of a tile without the lines that end the tile before it."""
    clean = lambda t: [" ".join(x.split()) for x in t.splitlines() if x.strip()]
    a, b = clean(before), clean(after)
    for n in range(min(SHARED_LINES, len(a), len(b)), 0, -1):
        if a[-n:] == b[:n]:
            return "\n".join(b[n:])
    return after
