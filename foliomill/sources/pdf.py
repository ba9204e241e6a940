"""A small PDF reader: objects and object streams, Flate, fonts with their widths and Unicode maps, the text and path operators.

Of each page it gives words, rules, painted shapes and images with boxes in page units (0 to 1, from the top left). Pages it
cannot read are marked as failed, and routing sends these to vision.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

from foliomill.sources.package import Rejected

#: Pages of a document, and words, painted objects, characters that are taken of it.
PAGES, WORDS, OBJECTS, CHARS = 300, 10_000, 1_000, 1_000_000
#: Bytes that the streams of a document may inflate to, and how deep forms may hold forms.
INFLATED, FORMS = 64 << 20, 4
WHITE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
SPACES = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
#: Names of glyphs that are neither letters nor in Unicode's own names.
GLYPHS = {"space": " ", "hyphen": "-", "period": ".", "parenleft": "(", "parenright": ")", "quoteright": "’", "quoteleft": "‘", "quotesingle": "'", "quotedblleft": "“", "quotedblright": "”", "quotedbl": '"', "endash": "–", "emdash": "—", "bullet": "•", "slash": "/", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "exclam": "!", "question": "?", "percent": "%", "ampersand": "&", "asterisk": "*", "plus": "+", "equal": "=", "less": "<", "greater": ">", "at": "@", "bracketleft": "[", "bracketright": "]", "underscore": "_", "numbersign": "#", "dollar": "$", "bar": "|", "braceleft": "{", "braceright": "}", "asciitilde": "~", "germandbls": "ß"}
MARKS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "ring": "̊", "caron": "̌"}


class Name(str):
    """A name object."""


class Ref(int):
    """A reference to an object."""


class Word(bytes):
    """An operator or keyword."""


def glyph(name: str) -> str:
    """The text of a glyph by its name."""
    base = name.split(".")[0]
    if base in GLYPHS or len(base) == 1:
        return GLYPHS.get(base, base)
    if m := re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", base):
        return chr(min(int(m[1], 16), 0x10FFFF))
    if (m := re.fullmatch(r"([A-Za-z])([a-z]+)", base)) and m[2] in MARKS:
        return unicodedata.normalize("NFC", m[1] + MARKS[m[2]])
    for long in (base.upper(), f"DIGIT {base.upper()}"):
        try:
            return unicodedata.lookup(long)
        except KeyError:
            continue
    return "�"


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, and where it ends."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, i + 1):
                out.append(int(m[0], 8) & 255)
                i = m.end()
                continue
            nxt = data[i + 1 : i + 2]
            out += b"" if nxt in (b"\n", b"\r") else ESCAPES.get(nxt, nxt)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        i += 1
        if not depth:
            break
        out += c
    return bytes(out), i


def read(data: bytes, at: int = 0):
    """(object, end) of the next object; (None, end) at the end of data."""
    at = SPACES.match(data, at).end()
    if at >= len(data):
        return None, at
    c = data[at : at + 1]
    if c == b"(":
        return literal(data, at)
    if data[at : at + 2] == b"<<":
        out, at = {}, at + 2
        while True:
            at = SPACES.match(data, at).end()
            if data[at : at + 2] == b">>" or at >= len(data):
                return out, at + 2
            key, at = read(data, at)
            value, at = read(data, at)
            out[str(key)] = value
    if c == b"<":
        end = data.find(b">", at)
        end = len(data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if c == b"[":
        items, at = [], at + 1
        while True:
            at = SPACES.match(data, at).end()
            if data[at : at + 1] == b"]" or at >= len(data):
                return items, at + 1
            item, at = read(data, at)
            items.append(item)
    if c == b"/":
        m = REGULAR.match(data, at + 1)
        text = m[0] if m else b""
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), text).decode("latin-1")), at + 1 + len(text)
    if m := NUMBER.match(data, at):
        if (r := re.compile(rb"(\d+)\s+\d+\s+R(?![A-Za-z])").match(data, at)) is not None:
            return Ref(r[1]), r.end()
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    if m := REGULAR.match(data, at):
        return {b"true": True, b"false": False}.get(m[0], Word(m[0])), m.end()
    return Word(c), at + 1


class Font:
    """Codes of a font as text and widths (in thousandths of the size)."""

    def __init__(self, pdf: Pdf, spec: dict):
        self.name = str(pdf.get(spec.get("BaseFont")) or "").split("+")[-1]
        self.wide = pdf.get(spec.get("Subtype")) == "Type0"
        own = pdf.get((pdf.get(spec.get("DescendantFonts")) or [spec])[0]) if self.wide else spec
        self.default = float(pdf.get(own.get("DW")) or 1000) if self.wide else 500.0
        self.widths: dict[int, float] = {}
        if self.wide:
            held = [pdf.get(x) for x in pdf.get(own.get("W")) or []]
            while len(held) > 1:
                first = int(held.pop(0))
                if isinstance(held[0], list):
                    self.widths.update((first + i, float(pdf.get(w))) for i, w in enumerate(held.pop(0)))
                elif len(held) > 1:
                    last, w = int(held.pop(0)), float(held.pop(0))
                    self.widths.update((i, w) for i in range(first, min(last, first + 65535) + 1))
        else:
            first = int(pdf.get(spec.get("FirstChar")) or 0)
            self.widths = {first + i: float(pdf.get(w)) for i, w in enumerate(pdf.get(spec.get("Widths")) or [])}
        self.texts = self.mapped(pdf.stream_of(spec.get("ToUnicode")))
        encoding = pdf.get(spec.get("Encoding"))
        if isinstance(encoding, dict) and not self.wide:
            at = 0
            for x in pdf.get(encoding.get("Differences")) or []:
                if isinstance(x, Name):
                    self.texts.setdefault(at, glyph(x))
                    at += 1
                else:
                    at = int(x)

    @staticmethod
    def mapped(cmap: bytes) -> dict[int, str]:
        """Code -> text of a character map."""
        out: dict[int, str] = {}
        text = lambda b: b.decode("utf-16-be", "replace")
        for body in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
            items, _ = read(b"[" + body + b"]")
            out.update((int.from_bytes(a, "big"), text(b)) for a, b in zip(items[::2], items[1::2]))
        for body in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
            items, _ = read(b"[" + body + b"]")
            for low, high, to in zip(items[::3], items[1::3], items[2::3]):
                first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for i in range(min(last - first, 65535) + 1):
                    if isinstance(to, list):
                        out[first + i] = text(to[i]) if i < len(to) else "�"
                    else:
                        out[first + i] = text(to[:-2] + ((int.from_bytes(to[-2:], "big") + i) & 0xFFFF).to_bytes(2, "big"))
        return out

    def glyphs(self, raw: bytes):
        """(text, width, whether it is the one-byte blank) of each code."""
        step = 2 if self.wide else 1
        for i in range(0, len(raw) - step + 1, step):
            code = int.from_bytes(raw[i : i + step], "big")
            text = self.texts.get(code)
            if text is None:
                text = f"(cid:{code})" if self.wide else bytes([code]).decode("cp1252", "replace")
            yield text, self.widths.get(code, self.default), step == 1 and code == 32


def times(a: tuple, b: tuple) -> tuple:
    """The transform a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def at(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Pdf:
    """Objects by number, and the pages in order."""

    def __init__(self, content: bytes, most: int = PAGES):
        if not content[:1024].lstrip().startswith(b"%PDF-"):
            raise Rejected("corrupt_document", "not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise Rejected("corrupt_document", "the document is encrypted")
        self.left = INFLATED
        self.objects: dict[int, bytes] = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.DOTALL)}
        self.parsed: dict[int, object] = {}
        for number in [n for n, b in self.objects.items() if b"/ObjStm" in b[:400]]:
            spec, data = self.get(Ref(number)), self.stream(self.objects[number])
            head = [*map(int, data[: spec["First"]].split()[: 2 * spec["N"]])]
            ends = [*head[3::2], len(data) - spec["First"]]
            for n, start, end in zip(head[::2], head[1::2], ends):
                self.objects.setdefault(n, data[spec["First"] + start : spec["First"] + end])
        catalog = next((x for n in self.objects if isinstance(x := self.get(Ref(n)), dict) and x.get("Type") == "Catalog"), {})
        if not isinstance(catalog.get("Pages"), Ref):
            raise Rejected("corrupt_document", "there are no pages")
        self.pages = [*self.walk(catalog["Pages"], {}, set())]
        if len(self.pages) > most:
            raise Rejected("limit_exceeded", "too many pages")
        self.font = lru_cache(maxsize=256)(lambda ref: Font(self, self.get(ref) or {}))

    def get(self, x):
        """An object, references followed."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            if x not in self.parsed:
                self.parsed[x] = read(self.objects.get(x, b""))[0]
            x = self.parsed[x]
        return None

    def walk(self, ref, above: dict, seen: set):
        """Page dictionaries in order, with what they inherit."""
        node = self.get(ref)
        if not isinstance(node, dict) or ref in seen:
            return
        seen.add(ref)
        whole = {k: v for k, v in above.items() if k in ("Resources", "MediaBox", "CropBox", "Rotate")} | node
        kids = self.get(node.get("Kids"))
        if isinstance(kids, list):
            for kid in kids:
                yield from self.walk(kid, whole, seen)
        else:
            yield whole

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.DOTALL)
        if not m:
            return b""
        data = m[1]
        if b"/FlateDecode" in body[: m.start()]:
            data = zlib.decompressobj().decompress(data, self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise Rejected("limit_exceeded", "streams inflate to too much")
        return data

    def stream_of(self, ref) -> bytes:
        return self.stream(self.objects.get(ref, b"")) if isinstance(ref, Ref) else b""

    def contents(self, page: dict) -> bytes:
        held = self.get(page.get("Contents"))
        return b"\n".join(map(self.stream_of, held)) if isinstance(held, list) else self.stream_of(page.get("Contents"))

    def facts(self, page: dict) -> dict:
        """words (text, box, size, font), rules and shapes (boxes), images (boxes), of a page."""
        box = [float(self.get(x)) for x in self.get(page.get("CropBox")) or self.get(page.get("MediaBox")) or (0, 0, 612, 792)]
        x0, y0, wide, high = min(box[0], box[2]), min(box[1], box[3]), abs(box[2] - box[0]) or 1.0, abs(box[3] - box[1]) or 1.0
        turned = int(self.get(page.get("Rotate")) or 0) // 90 % 4
        scale = wide if turned % 2 else high

        def place(points) -> tuple[float, float, float, float]:
            xs, ys = [(x - x0) / wide for x, _ in points], [1 - (y - y0) / high for _, y in points]
            for _ in range(turned):
                xs, ys = [1 - y for y in ys], xs
            cut = lambda v: min(max(v, 0.0), 1.0)
            return cut(min(xs)), cut(min(ys)), cut(max(xs)), cut(max(ys))

        out = {"words": [], "rules": [], "shapes": [], "images": [], "height": scale}
        self.run(self.contents(page), self.get(page.get("Resources")) or {}, ONE, place, out, 0)
        return out

    def run(self, data: bytes, resources: dict, ctm: tuple, place, out: dict, depth: int) -> None:
        fonts, forms = self.get(resources.get("Font")) or {}, self.get(resources.get("XObject")) or {}
        stack, saved, path, here = [], [], [], (0.0, 0.0)
        plain = Font(self, {})
        state = {"font": plain, "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "ts": 0.0}
        tm = line = ONE
        word: list | None = None  # text, points, size, font of the word being shown

        def close() -> None:
            nonlocal word
            if word and word[0].strip():
                if len(out["words"]) >= WORDS:
                    raise Rejected("limit_exceeded", "too many words")
                out["words"].append({"text": word[0].strip(), "box": place(word[1]), "size": word[2], "font": word[3]})
            word = None

        def show(raw: bytes) -> None:
            nonlocal tm, word
            size, font = state["size"], state["font"]
            for text, width, blank in font.glyphs(raw):
                m = times(tm, ctm)
                grown = abs(m[3]) or abs(m[1]) or 1.0
                if not text.strip():
                    close()
                else:
                    start = at(m, 0, state["ts"])
                    if word and (abs(start[0] - word[4][0]) > 0.25 * size * grown or abs(start[1] - word[4][1]) > 0.25 * size * grown):
                        close()
                    points = [at(m, 0, state["ts"] - 0.2 * size), at(m, width / 1000 * size * state["tz"], state["ts"] + 0.8 * size)]
                    if word is None:
                        word = ["", [], size * grown, font.name, start]
                    word[0] += text
                    word[1] += points
                tm = times((1, 0, 0, 1, (width / 1000 * size + state["tc"] + (state["tw"] if blank else 0)) * state["tz"], 0), tm)
                if word:
                    word[4] = at(times(tm, ctm), 0, state["ts"])

        def paint() -> None:
            nonlocal path
            for a, b in path:
                box = place([at(ctm, *a), at(ctm, *b)])
                if len(out["rules"]) + len(out["shapes"]) < OBJECTS:
                    out["rules" if min(box[2] - box[0], box[3] - box[1]) < 0.004 else "shapes"].append(box)
            path = []

        i = 0
        while True:
            x, i = read(data, i)
            if x is None and i >= len(data):
                break
            if not isinstance(x, Word):
                stack.append(x)
                continue
            n = [v for v in stack if isinstance(v, int | float)]
            if x == b"BT":
                tm = line = ONE
            elif x == b"ET":
                close()
            elif x == b"Tf" and len(stack) > 1:
                ref = fonts.get(str(stack[-2]))
                state["font"], state["size"] = (self.font(ref) if isinstance(ref, Ref) else Font(self, ref) if isinstance(ref, dict) else plain), float(stack[-1])
            elif x in (b"Td", b"TD") and len(n) > 1:
                close()
                state["tl"] = -n[-1] if x == b"TD" else state["tl"]
                tm = line = times((1, 0, 0, 1, n[-2], n[-1]), line)
            elif x == b"Tm" and len(n) > 5:
                close()
                tm = line = tuple(map(float, n[-6:]))
            elif x in (b"T*", b"'", b'"'):
                close()
                if x == b'"' and len(n) > 1:
                    state["tw"], state["tc"] = n[0], n[1]
                tm = line = times((1, 0, 0, 1, 0, -state["tl"]), line)
            elif x in (b"Tc", b"Tw", b"TL", b"Ts") and n:
                state[x.decode().lower()] = n[-1]
            elif x == b"Tz" and n:
                state["tz"] = n[-1] / 100
            elif x == b"q":
                saved.append((ctm, dict(state)))
            elif x == b"Q" and saved:
                ctm, state = saved.pop()
            elif x == b"cm" and len(n) > 5:
                ctm = times(tuple(map(float, n[-6:])), ctm)
            elif x == b"re" and len(n) > 3:
                path.append(((n[-4], n[-3]), (n[-4] + n[-2], n[-3] + n[-1])))
            elif x == b"m" and len(n) > 1:
                here = (n[-2], n[-1])
            elif x == b"l" and len(n) > 1:
                path.append((here, (n[-2], n[-1])))
                here = (n[-2], n[-1])
            elif x in (b"c", b"v", b"y") and len(n) > 3:
                path.append((here, (n[-2], n[-1])))
                here = (n[-2], n[-1])
            elif x in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                paint()
            elif x == b"n":
                path = []
            elif x == b"Do" and stack:
                ref = forms.get(str(stack[-1]))
                spec = self.get(ref) or {}
                if spec.get("Subtype") == "Image":
                    out["images"].append(place([at(ctm, 0, 0), at(ctm, 1, 1), at(ctm, 1, 0), at(ctm, 0, 1)]))
                elif spec.get("Subtype") == "Form" and depth < FORMS:
                    matrix = tuple(float(self.get(v)) for v in self.get(spec.get("Matrix")) or ONE)
                    self.run(self.stream_of(ref), self.get(spec.get("Resources")) or resources, times(matrix, ctm), place, out, depth + 1)
            elif x == b"BI":  # an image in the stream itself
                end = re.compile(rb"\sEI(?=\s|$)").search(data, i)
                out["images"].append(place([at(ctm, 0, 0), at(ctm, 1, 1)]))
                i = end.end() if end else len(data)
            if x in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                show(stack[-1])
            elif x == b"TJ" and stack and isinstance(stack[-1], list):
                for part in stack[-1]:
                    if isinstance(part, bytes) and not isinstance(part, Word):
                        show(part)
                    elif isinstance(part, int | float):
                        tm = times((1, 0, 0, 1, -part / 1000 * state["size"] * state["tz"], 0), tm)
            stack = []
        close()

    def page_facts(self):
        """page_number, failed and the facts of each page."""
        for number, page in enumerate(self.pages, 1):
            try:
                yield {"page_number": number, "failed": False, **self.facts(page)}
            except (zlib.error, ValueError, IndexError, TypeError, KeyError, AttributeError, RecursionError):
                yield {"page_number": number, "failed": True, "words": [], "rules": [], "shapes": [], "images": [], "height": 792.0}
