"""Text functions on columns that follow Unicode rules rather than the JVM's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as it stands in a character class of Java and of RE2 alike.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Characters with a meaning inside a Markdown line, and in the target of a link.
INLINE, TARGET = r"([\\`*_\[\]<>])", r"([\\()])"
SAFE_SCHEMES = ("http", "https", "mailto")


def strip(text: Column) -> Column:
    """`text` without white space at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$(?!\\n)", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_trailing_newlines(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


def escape(text: Column) -> Column:
    """Plain text as Markdown: inline characters first, then what would begin a block at the start of a line."""
    start = r"(?md)^([ \t]{0,3})"
    out = F.regexp_replace(text, INLINE, r"\\$1")
    out = F.regexp_replace(out, start + r"([#>])", r"$1\\$2")
    out = F.regexp_replace(out, start + rf"([-+])(?=[{SPACE}])", r"$1\\$2")
    return F.regexp_replace(out, start + rf"(\p{{Nd}}+)([.)])(?=[{SPACE}])", r"$1$2\\$3")


def pipe_cell(text: Column) -> Column:
    out = newlines(F.coalesce(text, F.lit("")))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_cell(text: Column) -> Column:
    out = newlines(F.coalesce(text, F.lit("")))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_target(target: Column) -> Column:
    """Whether a link's target may be rendered: a fragment, or one of the safe schemes."""
    scheme = F.lower(F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return target.startswith("#") | scheme.isin(*SAFE_SCHEMES)


def valid_target(target: Column) -> Column:
    """Whether a link's target can be kept at all: not empty, no white space or control characters."""
    return (F.length(target) > 0) & ~target.rlike(rf"[{SPACE}\x00-\x1f\x7f-\x9f]")


def link(label: Column, target: Column) -> Column:
    """A Markdown link, or the label alone where the target is not safe."""
    safe = F.coalesce(safe_target(target), F.lit(False))
    tail = F.concat(F.lit("]("), F.regexp_replace(target, TARGET, r"\\$1"), F.lit(")"))
    return F.concat(F.when(safe, "[").otherwise(""), escape(label), F.when(safe, tail).otherwise(""))


def fenced(text: Column) -> Column:
    """A code block whose fence is longer than any run of backticks in it."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def lines(text: Column) -> Column:
    """Lines as Unicode line ends divide them; no empty last line."""
    parts = F.split(text, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
