"""Exact token counts with overlap resynchronisation (operator 5).

A text over `chunk` characters is encoded in chunks that overlap. Where two chunks meet, the count is spliced at a boundary
that both encodings have and that is proven stable: it follows white space, which ends every token of this vocabulary, and
the run that starts there lies whole in both chunks with the same offsets and the same ids. If the overlap holds no such
boundary (one endless word, or white space only), the overlap is doubled until one is found or the chunk reaches the end.

Input: documents (doc_id, text). Null text counts as empty: 0 bytes, 0 tokens. Null or repeated doc_ids are kept, a row for
each input row. An empty table gives an empty table. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foliomill.llm.bpe import FIELD, Cache, load, vocabulary, words_of
from foliomill.llm.common import short, texts

#: Characters in a chunk and in an overlap, and the tokens over which a document is marked.
CHUNK, OVERLAP, LIMIT = 32_768, 512, 2048


#: Ids of each of some runs without white space.
Encode = Callable[[list[str]], list[tuple]]


class Chunk:
    """The encoding of text[start:stop] as runs: absolute offsets, and ids by run."""

    def __init__(self, text: str, start: int, stop: int, ids_of: Encode):
        self.start, self.stop = start, min(stop, len(text))
        found = [(m.start(), m.end()) for m in FIELD.finditer(text, self.start, self.stop)]
        self.runs = [(s, e, ids) for (s, e), ids in zip(found, ids_of([text[s:e] for s, e in found]))]

    def stable(self, text: str) -> dict[int, tuple[int, tuple]]:
        """Runs that the chunk's ends cannot have cut: a white space stands before, and one behind or the text ends."""
        return {s: (e, ids) for s, e, ids in self.runs if (s > self.start or s == 0) and (e < self.stop or e == len(text))}


def splice(text: str, left: Chunk, right: Chunk) -> int | None:
    """The first stable boundary that both chunks have, if there is one."""
    if not right.runs:
        return None
    mine = {s: (e, ids) for s, (e, ids) in left.stable(text).items() if s >= right.start}
    return next((s for s, found in right.stable(text).items() if mine.get(s) == found), None)


def count(text: str, ids_of: Encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a whole text, counted chunk by chunk."""
    total, left, cut = 0, Chunk(text, 0, chunk, ids_of), 0  # cut: where the left chunk's own runs begin
    while left.stop < len(text):
        width, boundary = overlap, None
        while boundary is None:
            right = Chunk(text, max(cut, left.stop - width), left.stop + chunk, ids_of)
            boundary = splice(text, left, right)
            if boundary is None or boundary <= cut and boundary:  # widen: the left chunk reaches further, and so does the overlap
                boundary, width = None, 2 * width
                left = Chunk(text, left.start, left.stop + width, ids_of)
                if left.stop >= len(text):
                    break
        if boundary is None:
            break
        total += sum(len(ids) for s, _, ids in left.runs if cut <= s < boundary)
        left, cut = right, boundary
    return total + sum(len(ids) for s, _, ids in left.runs if s >= cut)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        ids_of, size_of = Cache(bpe, tuple), Cache(bpe, len)
        for batch in short(batches):
            held = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes = [len(t.encode()) for t in held]
            n_tokens = [sum(sizes) for sizes in size_of.of([words_of(t) if len(t) <= chunk else [] for t in held])]
            for i, text in enumerate(held):
                if len(text) > chunk:
                    n_tokens[i] = count(text, lambda words: ids_of.of([words])[0], chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
