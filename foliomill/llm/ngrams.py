"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters taken together; a longer text is taken alone and whole.
TOGETHER = 1 << 18
MIX = np.uint32(0x9E3779B1)


def code_points(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each between blanks (`pad` behind it), and where each begins and its end lies."""
    parts = [f" {t.lower()}{' ' * pad}" for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.append(0, np.cumsum(size))


def grams(texts: list[str], sizes: tuple[int, ...], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram that starts in a text, for each size; `dims` is a power of two."""
    pad = max(sizes)
    codes, ends = code_points(texts, pad)
    number = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    inside = np.ones(len(codes), bool)
    for k in range(1, pad):  # starts in the blanks behind a text aren't counted, so no n-gram reaches the next text
        inside[ends[1:] - k] = False
    shift = np.uint32(32 - dims.bit_length() + 1)
    h = codes * np.uint32(0x85EBCA6B)
    for n in range(1, pad + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n in sizes:
            ok = inside[: len(h)]
            mixed = (h ^ h >> np.uint32(15)) * MIX ^ np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            yield number[: len(h)][ok], ((mixed ^ mixed >> np.uint32(13)) * MIX >> shift)[ok].astype(np.int32)


def batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about TOGETHER characters, with the number of the first."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > TOGETHER:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]
