"""One document at a time: a path, bytes or an open file to Markdown; errors are raised with their code."""

from __future__ import annotations

import asyncio
import os
import warnings
from typing import BinaryIO

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from foliomill.errors import error
from foliomill.operators import vision
from foliomill.operators.text import OUTPUT_CHARS
from foliomill.plans import documents
from foliomill.sources import files

#: Fixed value: seconds that a document may take.
TIMEOUT = 900.0


class DocumentWarning(UserWarning):
    """Something of a document that was left out or changed; `code` says what."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def parse(source: str | os.PathLike | bytes | BinaryIO, *, name: str | None = None, client: vision.Client | None = None, budget: int = OUTPUT_CHARS, timeout: float = TIMEOUT, spark: SparkSession | None = None) -> str:
    """Markdown of a document. name: of bytes and open files, whose suffix says what they are. Not to be called where an event loop
    runs; `aparse` is for that."""
    try:
        asyncio.get_running_loop()
    except RuntimeError:
        return _parse(source, name, client, budget, timeout, spark)
    raise error("sync_in_async_context", "use aparse in a coroutine")


async def aparse(source, **options) -> str:
    """`parse` in a thread, for coroutines."""
    args = {"name": None, "client": None, "budget": OUTPUT_CHARS, "timeout": TIMEOUT, "spark": None} | options
    return await asyncio.to_thread(_parse, source, *(args[k] for k in ("name", "client", "budget", "timeout", "spark")))


def _parse(source, name, client, budget, timeout, spark) -> str:
    spark = spark or SparkSession.builder.getOrCreate()
    if isinstance(budget, bool) or not isinstance(budget, int) or budget < 1:
        raise TypeError("budget must be a whole number from 1")
    if hasattr(source, "read"):
        name, source = name or os.path.basename(str(getattr(source, "name", ""))) or None, source.read()
        if not isinstance(source, bytes):
            raise error("invalid_source", "the file is not open for bytes")
    if isinstance(source, bytes):
        rows = files.from_memory(spark, [(name, source)])
    elif isinstance(source, str | os.PathLike):
        path = os.fspath(source)
        if files.remote(path):
            raise error("invalid_source", "remote sources are not fetched")
        if not os.path.isfile(path):
            raise error("invalid_source", "there is no such file")
        if not os.access(path, os.R_OK):
            raise error("invalid_source", "the file cannot be read")
        rows = files.read(spark, os.path.abspath(path))
    else:
        raise TypeError("source must be a path, bytes or an open file")
    try:
        out = documents.parse(rows, client, budget, timeout).first()
    except AnalysisException as e:
        raise error("invalid_source", "the source cannot be read") from e
    if out is None or out.error_code:
        raise error(out.error_code if out else "invalid_source")
    for w in out.warnings:
        code, _, message = w.partition(": ")
        warnings.warn(DocumentWarning(code, message), stacklevel=3)
    return out.markdown
