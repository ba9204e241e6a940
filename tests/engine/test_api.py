import asyncio
import io
import time

import pytest

from foliomill import api, errors
from foliomill.plans import documents
from foliomill.sources import files, package


def test_paths_bytes_and_open_files(spark, tmp_path):
    at = tmp_path / "a b.txt"
    at.write_bytes(b"one\r\n\r\ntwo")
    assert api.parse(at) == api.parse(b"one\n\ntwo", name="x.txt") == "one\n\ntwo\n"
    with open(at, "rb") as f:
        assert api.parse(f) == "one\n\ntwo\n"
    assert api.parse(io.BytesIO(b"plain")) == "plain\n"
    assert asyncio.run(api.aparse(at)) == "one\n\ntwo\n"
    for source, code in (("https://x.org/a.txt", "invalid_source"), (str(tmp_path / "none.txt"), "invalid_source"), (tmp_path, "invalid_source"), (b"<p>", None), (io.StringIO("x"), "invalid_source")):
        with pytest.raises(errors.ERRORS[code or "unsupported_document"]) as e:
            api.parse(source, name="a.html" if code is None else None)
        assert not e.value.retryable
    with pytest.raises(TypeError):
        api.parse(5)
    with pytest.raises(TypeError):
        api.parse(b"x", budget=True)

    async def inside():
        api.parse(at)

    with pytest.raises(errors.ERRORS["sync_in_async_context"]):
        asyncio.run(inside())
    assert errors.catalog(spark).where("retryable").count() == 2


def test_readers_are_registered_and_timed(spark):
    def slow(content):
        time.sleep(5)
        yield {"kind": "text", "text": "late"}

    before = documents.READERS["pdf"]
    try:
        documents.register("pdf", slow)
        out = documents.parse(files.from_memory(spark, [("a.pdf", b"%PDF-1.4")]), timeout=0.2).collect()[0]
        assert out.error_code == "timeout" and out.retryable
        documents.register("pdf", lambda c: iter([{"kind": "text", "text": "mine"}]))
        assert documents.parse(files.from_memory(spark, [("a.pdf", b"%PDF-1.4")])).collect()[0].markdown == "mine\n"
    finally:
        documents.register("pdf", before)
    with pytest.raises(TypeError):
        documents.register("", None)
    with package.deadline(None):
        pass
