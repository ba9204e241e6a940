"""What a source is: checks of its name, and a decision table of suffix and signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document types by suffix, schemes that are refused, bytes a source may have.
SUFFIXES = {".txt": "text", ".md": "markdown", ".markdown": "markdown", ".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx"}
REMOTE = ("http", "https", "s3", "oss")
SOURCE_BYTES = 100_000_000


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last suffix in lower case; empty if there is none. A leading dot makes no suffix."""
    return F.lower(F.regexp_extract(basename(name), r"[^.].*?(\.[^.]+)$", 1))


def source_error(name: Column, length: Column) -> Column:
    """An error code for sources that cannot be read, else null."""
    scheme = F.lower(F.regexp_extract(name, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin(*REMOTE), "invalid_source").when(length > SOURCE_BYTES, "limit_exceeded")


def portable(name: Column) -> Column:
    """Whether a name can be a file's on any system."""
    stem = F.upper(F.rtrim(F.element_at(F.split(name, r"\."), 1)))
    reserved = stem.isin("CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$") | stem.rlike("^(?:COM|LPT)[1-9¹²³]$")
    return (F.length(name) > 0) & ~name.rlike(r'[\x00-\x1f\x7f<>:"/\\|?*]|[ .]$') & ~reserved


def signature(content: Column) -> Column:
    """The type that the first bytes tell, `zip` for a package, else null."""
    head = F.hex(F.substring(content, 1, 16))
    at = lambda *x: head.startswith("".join(x))
    return (
        F.when(at("255044462D"), "pdf").when(at("89504E470D0A1A0A") | at("FFD8FF"), "image")
        .when(at("52494646") & (F.substring(head, 17, 8) == "57454250"), "image")
        .when(at("504B0304") | at("504B0506") | at("504B0708"), "zip")
    )


def package_type(members: Column) -> Column:
    """The type of a ZIP container by the names of its members."""
    has = lambda m: F.array_contains(members, m)
    return F.when(has("word/document.xml"), "docx").when(has("ppt/presentation.xml"), "pptx").when(has("xl/workbook.xml"), "xlsx")


def detect(sources: DataFrame) -> DataFrame:
    """`sources` (name, content; members for packages) with document_type and error_code.

    A suffix that is not known is unsupported. A declared type must agree with the signature; text must have none and be valid
    UTF-8. Without a suffix the signature decides, else valid UTF-8 is text.
    """
    end = suffix(F.coalesce("name", F.lit("")))
    declared = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[F.when(end.isin(*SUFFIXES), end)]
    by_bytes = signature(F.col("content"))
    members = F.col("members") if "members" in sources.columns else F.lit(None).cast("array<string>")
    found = F.when(by_bytes == "zip", package_type(members)).otherwise(by_bytes)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    rows = sources.withColumns({"_end": end, "_declared": declared, "_raw": by_bytes, "_found": found, "_utf8": utf8})
    c = F.col
    texts = c("_declared").isin("text", "markdown")
    error = (
        F.when((c("_end") != "") & c("_declared").isNull(), "unsupported_document")
        .when((c("_raw") == "zip") & members.isNull(), "corrupt_document")
        .when((c("_raw") == "zip") & c("_found").isNull(), F.when(c("_declared") == "xlsx", "corrupt_document").otherwise("unsupported_document"))
        .when(texts & c("_found").isNotNull(), "document_type_mismatch")
        .when(texts & ~c("_utf8"), "corrupt_document")
        .when(~texts & ~c("_found").eqNullSafe(c("_declared")), "document_type_mismatch")
        .when(c("_declared").isNull() & c("_found").isNull() & ~c("_utf8"), "unsupported_document")
    )
    kind = F.coalesce("_declared", "_found", F.lit("text"))
    return rows.withColumn("error_code", error).withColumn("document_type", F.when(c("error_code").isNull(), kind)).drop("_end", "_declared", "_raw", "_found", "_utf8")
