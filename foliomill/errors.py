"""The ways in which a document can fail, as rows, and as exceptions for callers of a single document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Every error code, and whether another try may help.
CODES = {
    "invalid_source": False, "unsupported_document": False, "document_type_mismatch": False, "corrupt_document": False, "limit_exceeded": False, "timeout": True, "vision_required": False,
    "model_authentication": False, "model_permission": False, "model_invalid_request": False, "model_unavailable": True, "model_invalid_response": False, "runtime_dependency": False,
    "no_usable_content": False, "sync_in_async_context": False,
}
RETRYABLE = tuple(c for c, again in CODES.items() if again)


class DocumentError(Exception):
    """A document that could not be turned into Markdown; there is a subclass for every code in `ERRORS`."""

    code = ""

    def __init__(self, message: str = ""):
        super().__init__(message or self.code.replace("_", " "))
        self.retryable = CODES[self.code]


ERRORS: dict[str, type[DocumentError]] = {c: type(c.title().replace("_", ""), (DocumentError,), {"code": c, "__doc__": f"{c.replace('_', ' ')}."}) for c in CODES}


def error(code: str, message: str = "") -> DocumentError:
    return ERRORS[code](message)


def catalog(spark: SparkSession) -> DataFrame:
    """error_code, retryable."""
    return spark.createDataFrame(list(CODES.items()), "error_code string, retryable boolean")
