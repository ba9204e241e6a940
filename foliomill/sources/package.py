"""The trust boundary of ZIP packages: what a package must be before its parts are read."""

from __future__ import annotations

import io
import posixpath
import re
import signal
import threading
import zipfile
from contextlib import contextmanager
from xml.parsers import expat

#: The limits of a package.
MEMBERS, TOTAL, XML_PART, MEDIA, MEDIA_PART, MEDIA_TOTAL, RATIO = 2048, 32 << 20, 4 << 20, 256, 16 << 20, 24 << 20, 100
MAIN = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}
#: Fixed value: what a workbook's main part says it is.
WORKBOOK = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"


class Rejected(Exception):
    """A package that may not be read; `code` is the document's error."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@contextmanager
def deadline(seconds: float | None):
    """Rejects what takes longer. Works in the main thread of a process, which is where workers run; elsewhere there is no limit."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise Rejected("timeout", "the document took too long")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def members(content: bytes) -> list[str] | None:
    """Names in a ZIP container, or None if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [i.filename for i in z.infolist()]
    except (zipfile.BadZipFile, ValueError, EOFError):
        return None


def safe(name: str) -> bool:
    """Whether a member's name stays inside the package."""
    parts = name.rstrip("/").split("/")
    return bool(name) and not re.search(r"[\x00-\x1f\\]|^/|^[A-Za-z]:", name) and not any(p in ("", ".", "..") for p in parts)


def tree(xml: bytes) -> list:
    """A part as [tag, attributes, children, text, tail] with local names; document types and entities are refused."""
    root: list = ["", {}, [], "", ""]
    stack = [root]
    local = lambda n: n.rsplit("}", 1)[-1]

    def start(name, attrs):
        node = [local(name), {local(k): v for k, v in attrs.items()}, [], "", ""]
        stack[-1][2].append(node)
        stack.append(node)

    def text(data):
        node = stack[-1]
        if node[2]:
            node[2][-1][4] += data
        else:
            node[3] += data

    def refuse(*_):
        raise Rejected("corrupt_document", "document types are not allowed in a package")

    p = expat.ParserCreate(namespace_separator="}")
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda _: stack.pop(), text
    p.StartDoctypeDeclHandler = p.EntityDeclHandler = refuse
    p.buffer_text = True
    try:
        p.Parse(xml, True)
    except expat.ExpatError as e:
        raise Rejected("corrupt_document", "a part is not well-formed") from e
    return root[2][0]


def find(node: list, *path: str) -> list | None:
    for name in path:
        node = next((c for c in node[2] if c[0] == name), None)
        if node is None:
            return None
    return node


def every(node: list, name: str) -> list[list]:
    """Descendants of one name, in document order."""
    out = []
    for c in node[2]:
        if c[0] == name:
            out.append(c)
        out += every(c, name)
    return out


class Package:
    """A package that passed the checks, in the order a scan meets them."""

    def __init__(self, content: bytes, kind: str):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            infos = self.zip.infolist()
        except (zipfile.BadZipFile, ValueError, EOFError) as e:
            raise Rejected("corrupt_document", "the container is corrupt") from e
        self.kind, self.names = kind, {i.filename for i in infos}
        if len(infos) > MEMBERS:
            raise Rejected("limit_exceeded", "too many members")
        if len(self.names) != len(infos):
            raise Rejected("corrupt_document", "members repeat")
        total = media = media_bytes = 0
        for i in infos:
            if not safe(i.filename):
                raise Rejected("corrupt_document", "a member's name is unsafe")
            if i.flag_bits & 1:
                raise Rejected("corrupt_document", "a member is encrypted")
            total += i.file_size
            is_media = "/media/" in i.filename
            media, media_bytes = media + is_media, media_bytes + is_media * i.file_size
            if total > TOTAL or (i.filename.endswith((".xml", ".rels")) and i.file_size > XML_PART) or i.file_size > RATIO * max(i.compress_size, 1):
                raise Rejected("limit_exceeded", "a member or the package is too large")
            if media > MEDIA or media_bytes > MEDIA_TOTAL or (is_media and i.file_size > MEDIA_PART):
                raise Rejected("limit_exceeded", "too many media")
        if "[Content_Types].xml" not in self.names or MAIN[kind] not in self.names:
            raise Rejected("corrupt_document", "a required part is missing")
        types = [o[1] for o in every(self.xml("[Content_Types].xml"), "Override") if o[1].get("PartName") == "/" + MAIN[kind]]
        if kind == "xlsx" and not any(t.get("ContentType") == WORKBOOK for t in types):
            raise Rejected("corrupt_document", "the main part is not a workbook")
        if not any(t == MAIN[kind] for t, _, _ in self.relations("").values()):
            raise Rejected("corrupt_document", "the main part is not related to the package")

    def read(self, name: str) -> bytes:
        try:
            return self.zip.read(name)
        except (KeyError, zipfile.BadZipFile, OSError, ValueError, EOFError) as e:
            raise Rejected("corrupt_document", "a part cannot be read") from e

    def xml(self, name: str) -> list | None:
        return tree(self.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id -> (target, type, external) of a part; internal targets must be members."""
        base, name = posixpath.split(part)
        root = self.xml(posixpath.join(base, "_rels", name + ".rels"))
        out = {}
        for r in root[2] if root else ():
            target, external = r[1].get("Target", ""), r[1].get("TargetMode") == "External"
            if not external:
                target = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))
                if target not in self.names:
                    raise Rejected("corrupt_document", "a relationship has no target")
            if r[1].get("Id") in out:
                raise Rejected("corrupt_document", "relationship ids repeat")
            out[r[1].get("Id")] = (target, r[1].get("Type", ""), external)
        return out
