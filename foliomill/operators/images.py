"""Images before a model sees them: what they are, whether they say anything, how they are cut, and where answers belong.

PNG is decoded here; of JPEG and WebP the headers are read, and their pixels are left to the client.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from foliomill.operators.geometry import LONG_SIDE, NARROW, OVERLAP, TALL, TILES
from foliomill.sources.package import Rejected

#: Sides and pixels that an image may have, and the ratio from which it is very wide.
SIDE, PIXELS, ULTRA_WIDE = 50_000, 40_000_000, 4.0
#: Suffixes of each format.
SUFFIXES = {"png": (".png",), "jpeg": (".jpg", ".jpeg"), "webp": (".webp",)}
#: An icon, where its place is known (share of the page, sides, coverage, parts, colours, edges) and where not.
ICON_SHARE, ICON_PLACED, ICON_LOOSE = 0.03, (256, 0.20, 2, 16, 0.25), (128, 0.15, 2, 8, 0.20)
SAMPLE, PARTS = 256, 4


@dataclass(frozen=True)
class Header:
    format: str
    width: int
    height: int
    frames: int


def header(content: bytes) -> Header:
    """Format, size and frames, from the file's own header."""
    if content.startswith(b"\x89PNG\r\n\x1a\n") and content[12:16] == b"IHDR":
        width, height = struct.unpack(">II", content[16:24])
        at = content.find(b"acTL", 24, 65536)
        return Header("png", width, height, struct.unpack(">I", content[at + 4 : at + 8])[0] if at > 0 else 1)
    if content.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                at += 1
                continue
            kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return Header("jpeg", int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big"), 1)
            at += 2 + (size if not 0xD0 <= kind <= 0xD9 and kind != 0xFF else 0)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        kind, data = content[12:16], content[20:]
        if kind == b"VP8X":
            return Header("webp", 1 + int.from_bytes(data[4:7], "little"), 1 + int.from_bytes(data[7:10], "little"), max(content.count(b"ANMF"), 1))
        if kind == b"VP8L":
            bits = int.from_bytes(data[1:5], "little")
            return Header("webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1)
        if kind == b"VP8 ":
            return Header("webp", int.from_bytes(data[6:8], "little") & 0x3FFF, int.from_bytes(data[8:10], "little") & 0x3FFF, 1)
    raise Rejected("corrupt_document", "the image has no known header")


def validated(content: bytes, name: str | None = None) -> Header:
    """The header of an image that may be taken: one frame, within the limits, and of the format that its name says."""
    h = header(content)
    if h.width < 1 or h.height < 1 or h.frames != 1:
        raise Rejected("corrupt_document", "the image has no size or several frames")
    if name and "." in name and not name.lower().endswith(SUFFIXES[h.format]):
        raise Rejected("document_type_mismatch", "the image is not what its name says")
    if h.width > SIDE or h.height > SIDE or h.width * h.height > PIXELS:
        raise Rejected("limit_exceeded", "the image is too large")
    return h


def pixels(content: bytes) -> np.ndarray | None:
    """height x width x 4 (RGBA) of a PNG with 8 bits and no interlace; None for other images."""
    h = validated(content)
    if h.format != "png" or len(content) < 33:
        return None
    depth, colour, _, _, interlace = content[24:29]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        return None
    data, palette, alpha, at = b"", None, None, 8
    while at + 8 <= len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        data += body if kind == b"IDAT" else b""
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" and size % 3 == 0 else palette
        alpha = np.frombuffer(body, np.uint8) if kind == b"tRNS" else alpha
        at += 12 + size
    row = h.width * channels
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(data, (row + 1) * h.height), np.uint8)
    except zlib.error as e:
        raise Rejected("corrupt_document", "the image cannot be read") from e
    if len(raw) < (row + 1) * h.height:
        raise Rejected("corrupt_document", "the image ends early")
    raw = raw[: (row + 1) * h.height].reshape(h.height, row + 1)
    out = np.zeros((h.height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(h.height):
        line = unfiltered(int(raw[y, 0]), raw[y, 1:], above, channels)
        out[y] = above = line
    out = out.reshape(h.height, h.width, channels)
    rgba = np.full((h.height, h.width, 4), 255, np.uint8)
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise Rejected("corrupt_document", "the image has no palette")
        rgba[..., :3] = palette[out[..., 0]]
        if alpha is not None:
            rgba[..., 3] = np.append(alpha, np.full(256, 255, np.uint8))[out[..., 0]]
    else:
        rgba[..., :3] = out[..., :3] if channels >= 3 else out[..., :1]
        if channels in (2, 4):
            rgba[..., 3] = out[..., -1]
    return rgba


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of a PNG with its filter undone."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:  # the sum over the pixels to the left
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
    out, up, raw = bytearray(len(line)), above.tolist(), line.tolist()
    for i, x in enumerate(raw):
        a, b, c = out[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = x + guess & 255
    return np.frombuffer(bytes(out), np.uint8)


def png(rgb: np.ndarray) -> bytes:
    """A PNG of height x width x 3, without anything but its pixels."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    high, wide = rgb.shape[:2]
    rows = np.concatenate([np.zeros((high, 1), np.uint8), rgb.reshape(high, wide * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def shrunk(image: np.ndarray, longest: int) -> np.ndarray:
    """The image with its longer side `longest` at most; every pixel the nearest one."""
    high, wide = image.shape[:2]
    scale = min(1.0, longest / max(high, wide))
    h, w = max(round(high * scale), 1), max(round(wide * scale), 1)
    return image[np.arange(h) * high // h][:, np.arange(w) * wide // w]


def flattened(rgba: np.ndarray) -> np.ndarray:
    """The image on a plain ground: white, or black if what is to be seen is bright."""
    alpha = rgba[..., 3:].astype(np.float32) / 255
    seen = rgba[..., 3] > 16
    bright = float(rgba[..., :3][seen].mean()) if seen.any() else 0.0
    ground = 0.0 if (rgba[..., 3] < 255).any() and bright > 200 else 255.0
    return (rgba[..., :3] * alpha + ground * (1 - alpha)).round().astype(np.uint8)


def facts(rgba: np.ndarray) -> dict:
    """alpha_coverage, foreground_coverage, components (up to `PARTS`), edge_density, color_count and blank of a small sample."""
    from foliomill.operators.regions import labelled

    small = shrunk(rgba, SAMPLE)
    flat, seen = flattened(small).astype(np.int16), small[..., 3] > 16
    border = np.concatenate([flat[0], flat[-1], flat[:, 0], flat[:, -1]])
    ground = np.median(border, axis=0)
    front = seen & (np.abs(flat - ground).max(axis=-1) > 24)
    grey = flat.mean(axis=-1)
    steps = [np.abs(np.diff(grey, axis=k)) > 24 for k in (0, 1)]
    edges = sum(int(s.sum()) for s in steps) / max(sum(s.size for s in steps), 1)
    at = np.argwhere(front)
    sizes = np.unique(labelled(at[:, 0], at[:, 1]), return_counts=True)[1] if len(at) else np.empty(0)
    colours = len(np.unique((flat // 32).reshape(-1, 3), axis=0))
    return {"alpha_coverage": float(seen.mean()), "foreground_coverage": float(front.mean()), "components": min(int((sizes > 4).sum()), PARTS), "edge_density": float(edges), "color_count": colours, "blank": float(front.mean()) < 0.001 and edges < 0.001}


def decorative(width: int, height: int, about: dict | None, share: float | None, alt: str = "") -> bool:
    """Whether an embedded image is an icon that says nothing: by the share of the page that it takes, else by its size alone."""
    if about is None or alt.strip() or share is not None and share > ICON_SHARE:
        return False
    side, coverage, parts, colours, edges = ICON_LOOSE if share is None else ICON_PLACED
    covered = min(about["alpha_coverage"], about["foreground_coverage"])
    return width <= side and height <= side and covered <= coverage and about["components"] <= parts and about["color_count"] <= colours and about["edge_density"] <= edges


def tile_ranges(width: int, height: int) -> list[tuple[int, int]]:
    """(top, bottom) of the tiles of an image: tall and narrow ones are cut, each tile sharing a tenth with the next."""
    scale = min(1.0, LONG_SIDE / max(width, height))
    if height / width < TALL or width * scale >= NARROW:
        return [(0, height)]
    size = min(height, max(LONG_SIDE, 2 * width))
    step = size - max(1, round(size * OVERLAP))
    n = 1 if size >= height else -(-(height - size) // step) + 1
    if n > TILES:
        raise Rejected("limit_exceeded", "the image would have too many tiles")
    return [(i * step, min(i * step + size, height)) for i in range(n)]


@dataclass(frozen=True)
class Prepared:
    """An image ready to be asked for: its tiles (bytes, top, bottom), what it is, and whether it is worth asking."""

    header: Header
    tiles: list[tuple[bytes, int, int]]
    facts: dict | None
    skip: bool


def prepare(content: bytes, name: str | None = None) -> Prepared:
    """Checks an image, looks at it, and cuts it. Images that cannot be decoded here are passed on whole, without their metadata."""
    h = validated(content, name)
    rgba = pixels(content)
    if rgba is None:
        return Prepared(h, [(without_metadata(content), 0, h.height)], None, False)
    about, flat = facts(rgba), flattened(rgba)
    tiles = [(png(shrunk(flat[a:b], LONG_SIDE)), a, b) for a, b in tile_ranges(h.width, h.height)]
    return Prepared(h, tiles, about, about["blank"])


def without_metadata(content: bytes) -> bytes:
    """A JPEG without its application segments and comments; other images as they are."""
    if not content.startswith(b"\xff\xd8"):
        return content
    out, at = bytearray(b"\xff\xd8"), 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if not (0xE1 <= content[at + 1] <= 0xEF or content[at + 1] == 0xFE):
            out += content[at : at + 2 + size]
        at += 2 + size
    return bytes(out) + content[at:]


def cropped(content: bytes, box: tuple[float, float, float, float]) -> bytes | None:
    """The part of an image in a box (shares of its sides), as PNG; None if it cannot be decoded here."""
    rgba = pixels(content)
    if rgba is None:
        return None
    high, wide = rgba.shape[:2]
    left, top, right, bottom = int(box[0] * wide), int(box[1] * high), -int(-box[2] * wide // 1), -int(-box[3] * high // 1)
    return png(flattened(rgba[top : max(bottom, top + 1), left : max(right, left + 1)]))


def placed(box: list[float] | None, within: tuple[float, float, float, float]) -> list[float] | None:
    """A box of a part (shares of the part) as a box of the whole."""
    if box is None:
        return None
    left, top, right, bottom = within
    return [left + box[0] * (right - left), top + box[1] * (bottom - top), left + box[2] * (right - left), top + box[3] * (bottom - top)]


def tile_prompt(prompt: str, tile: int, tiles: int) -> str:
    return prompt if tiles == 1 else f"{prompt}\nThis is part {tile + 1} of {tiles} of one tall image, from top to bottom; parts overlap. Give only what is seen in this part."


def merged_tiles(answers: list[list[dict] | None], ranges: list[tuple[int, int]], height: int, trim) -> list[dict]:
    """Elements of all tiles as those of one image. An element with a box stays if its centre lies in the tile's own core, which ends
    half way through the overlap; texts lose the lines that end the tile before; numbers are given anew."""
    out: list[dict] = []
    for k, (found, (top, bottom)) in enumerate(zip(answers, ranges)):
        start = (top + ranges[k - 1][1]) / 2 if k else 0
        end = (bottom + ranges[k + 1][0]) / 2 if k + 1 < len(ranges) else height
        for e in found or []:
            box = placed(e.get("bbox"), (0.0, top / height, 1.0, bottom / height))
            if box and not start <= (box[1] + box[3]) / 2 * height < end + (end == height):
                continue
            e = {**e, "bbox": box, "tile": k}
            if e["type"] == "text" and out and out[-1]["type"] == "text" and out[-1]["tile"] == k - 1:
                e["text"] = trim(out[-1]["text"], e["text"])
            if e["type"] == "table" or e["text"].strip():
                out.append(e)
    return [{k: v for k, v in e.items() if k != "tile"} | {"source_index": i} for i, e in enumerate(out)]
