"""BPE encoding and decoding with contiguous rank arrays (operator 10).

A word is held as two contiguous arrays: its parts, and for each boundary between neighbours the rank of their merge.
The least rank is found by scanning, its boundary deleted, and only the two neighbouring ranks are looked up again.
Words of like length lie in the rows of one pair of arrays, so that a scan, a deletion and a refresh serve all of them.
Words longer than `SHORT` parts take a heap with the same order of merges (least rank, then leftmost), so that one endless
word cannot take quadratic time.

Input: documents (doc_id, text). Null text counts as empty: no tokens, empty decoded text. Null or repeated doc_ids are kept,
one output row for each input row. Texts of any length are taken whole; ties of ranks go to the leftmost. An empty table gives an empty table. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliomill.llm.common import short, texts

#: Words up to so many parts are scanned, in arrays of these widths; longer ones use a heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128)
SHORT = WIDTHS[-1]
#: Entries a word cache may hold before it starts again; words over CACHED_CHARS are never held.
CACHE_WORDS, CACHED_CHARS = 250_000, 64
NO_RANK, PAD = np.int32(1 << 30), np.int32((1 << 16) - 1)

#: Unicode White_Space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FIELD = re.compile(f"[^{SPACES}]+")
#: Characters that str.split() takes for white space though Unicode's White_Space does not hold them.
SEPARATORS = re.compile("[\x1c-\x1f]")


#: Characters that Unicode has not had since version 3.2: letters, case and order of marks of these differ between the tables of
#: Python, of `regex` and of the library, so their words are normalised and split by the library itself.
@lru_cache(maxsize=1)
def recent() -> re.Pattern:
    old = unicodedata.ucd_3_2_0.category
    marks = [i for i in range(0x80, 0x10000) if old(chr(i)) in ("Cn", "Co", "Cs")]
    starts = [i for i, c in enumerate(marks) if i == 0 or marks[i - 1] != c - 1]
    ends = [*starts[1:], len(marks)]
    return re.compile("[" + "".join(f"\\u{marks[a]:04x}-\\u{marks[b - 1]:04x}" for a, b in zip(starts, ends)) + "\\U00010000-\\U0010ffff]")


def words_of(text: str) -> list[str]:
    """Runs without white space."""
    return FIELD.findall(text) if SEPARATORS.search(text) else text.split()


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Bpe:
    """A tokenizer of the family NFC, white space collapsed, lower case, split, byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        import regex

        vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens.update((i, t) for t, i in self.special.items())
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", SPACES)).findall
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merged.append(vocab[a + b])
            self.ranks.setdefault(vocab[a] << 16 | vocab[b], rank)
        if max(self.tokens) >= PAD:
            raise ValueError("ids must be under 65535")
        self.inner_ids, self.last_ids, self.merged_ids = (np.array(x, np.int32) for x in (self.inner, self.last, self.merged))
        self.slots, self.slot_ranks = self._hashed()
        self.plain: dict[str, str] = {}
        self.path, self.spec = path, spec

    @cached_property
    def library(self):
        """The library's normaliser and splitter of this vocabulary."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        split = next(x for x in self.spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        return Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])

    def cut(self, run: str) -> list[str]:
        """The pieces of the split of a run without white space and special tokens."""
        if run.isascii() or not recent().search(run):
            return self.pieces(self.normal(run))
        normal, split = self.library
        return [piece for piece, _ in split.pre_tokenize_str(normal.normalize_str(run))]

    def _hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by pair in a table with linear probing, so that many pairs are looked up at once; a pair at most `reach` slots on."""
        bits = max(8, (4 * len(self.ranks)).bit_length())
        self.shift, self.reach = np.uint32(32 - bits), 0
        slots, ranks = np.full((1 << bits) + 64, 0xFFFFFFFF, np.uint32), np.full((1 << bits) + 64, NO_RANK, np.int32)
        for pair, rank in self.ranks.items():
            at = (pair * 0x9E3779B1 & 0xFFFFFFFF) >> int(self.shift)
            far = 0
            while slots[at + far] != 0xFFFFFFFF:
                far += 1
            slots[at + far], ranks[at + far], self.reach = pair, rank, max(self.reach, far)
        return slots, ranks

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = (pair * np.uint32(0x9E3779B1) >> self.shift).astype(np.int64)
        out = np.where(self.slots[at] == pair, self.slot_ranks[at], NO_RANK)
        open_ = np.flatnonzero((self.slots[at] != pair) & (self.slots[at] != 0xFFFFFFFF))
        for far in range(1, self.reach + 1):
            if not len(open_):
                break
            here = self.slots[at[open_] + far]
            hit = here == pair[open_]
            out[open_[hit]] = self.slot_ranks[at[open_[hit]] + far]
            open_ = open_[~hit & (here != 0xFFFFFFFF)]
        return out

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Merges every row of `ids` (words x width, padded by PAD) as far as it goes."""
        done, rows = np.full_like(ids, PAD), np.arange(len(ids))
        near = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        column = np.arange(ids.shape[1])
        while len(rows):
            i = near.argmin(axis=1)
            k = np.arange(len(rows))
            least = near[k, i]
            go = least != NO_RANK
            if not go.all():
                done[rows[~go], : ids.shape[1]] = ids[~go]
                rows, ids, near, i, least = rows[go], ids[go], near[go], i[go], least[go]
                if not len(rows):
                    break
                k = k[: len(rows)]
            ids[k, i] = self.merged_ids[least]
            # the part behind the boundary goes, and the boundary's rank
            ids = np.where(column[: ids.shape[1] - 1] > i[:, None], ids[:, 1:], ids[:, :-1])
            near = np.where(column[: near.shape[1] - 1] >= i[:, None], near[:, 1:], near[:, :-1])
            if near.shape[1] == 0:
                done[rows, : ids.shape[1]] = ids
                break
            for at in (i - 1, i):  # the neighbours are looked up again
                ok = (at >= 0) & (at < near.shape[1])
                r, c = k[ok], at[ok]
                near[r, c] = self.rank_of(ids[r, c], ids[r, c + 1])
        return done

    def parts(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each of some pieces of the split."""
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.array([len(r) for r in raws], np.int64)
        out: list[list[int]] = [[]] * len(raws)
        low = 0
        for width in WIDTHS:
            at = np.flatnonzero((size > low) & (size <= width))
            low = width
            for some in np.array_split(at, len(at) // 8192 + 1) if len(at) else ():
                n = size[some]
                raw = np.frombuffer(b"".join(raws[j] for j in some), np.uint8)
                ids = np.full((len(some), width), PAD, np.int32)
                ids[np.arange(width) < n[:, None]] = self.inner_ids[raw]
                ids[np.arange(len(some)), n - 1] = self.last_ids[raw[np.cumsum(n) - 1]]
                merged = self.merge(ids)
                left = (merged != PAD).sum(axis=1).tolist()
                for j, row, m in zip(some.tolist(), merged.tolist(), left):
                    out[j] = row[:m]
        for j in np.flatnonzero(size > SHORT):
            ids = [self.inner[b] for b in raws[j]]
            ids[-1] = self.last[raws[j][-1]]
            out[j] = self.heaped(ids)
        return out

    def heaped(self, ids: list[int]) -> list[int]:
        n, rank_of = len(ids), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank_of(ids[x] << 16 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered alone: no final sigma
        return text.lower()

    def split(self, word: str) -> list[str | int]:
        """The pieces of a run without white space, or the ids of special tokens in it."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        if "<" not in word:
            return self.cut(word)
        out: list[str | int] = []
        for k, run in enumerate(self.split_special.split(word)):
            out += [self.special[run]] if k % 2 else self.cut(run)
        return out

    def words(self, words: list[str], known: dict[str, list[int]] | None = None) -> list[list[int]]:
        """Ids of each of some runs without white space, which can be encoded one by one, for white space ends every token."""
        known = {} if known is None else known
        split = [self.split(w) for w in words]
        new = [*{p for pieces in split for p in pieces if p not in known and not isinstance(p, int)}]
        found = dict(zip(new, self.parts(new)))
        if len(known) + len(new) > CACHE_WORDS:
            for p in {p for pieces in split for p in pieces if p in known}:
                found[p] = known[p]
            known.clear()
        known.update((p, ids) for p, ids in found.items() if len(p) <= CACHED_CHARS)
        of = lambda p: [p] if isinstance(p, int) else found[p] if p in found else known[p]
        return [of(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in of(p)] for pieces in split]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.words(words_of(text or "")) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; the vocabulary has no decoder, so tokens are joined by a space."""
        return " ".join([self.tokens[i] for i in ids])

    def decode_digits(self, words: list[str]) -> str:
        """Decodes ids written as decimals and joined by a space, a word at a time; words met before are remembered."""
        new = set(words).difference(self.plain)
        if len(self.plain) + len(new) > CACHE_WORDS:
            self.plain.clear()
            new = set(words)
        self.plain.update((w, self.decode([int(i) for i in w.split()])) for w in new)
        out = " ".join(map(self.plain.__getitem__, words))
        for w in new:
            if len(w) > 8 * CACHED_CHARS:
                del self.plain[w]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


class Cache:
    """What `make` gives for the ids of a word; starts again when full, so memory is bounded and results are not touched."""

    def __init__(self, bpe: Bpe, make):
        self.bpe, self.make, self.held, self.pieces = bpe, make, {}, {}

    def of(self, texts: list[list[str]]) -> list[list]:
        """For each list of words the list of values."""
        new = [*set().union(*texts).difference(self.held)]
        if len(self.held) + len(new) > CACHE_WORDS:
            self.held.clear()
            new = [*set().union(*texts)]
        self.held.update(zip(new, map(self.make, self.bpe.words(new, self.pieces))))
        out = [[*map(self.held.__getitem__, words)] for words in texts]
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.held[w]
        return out


def vocabulary() -> str:
    """Where the word-end vocabulary lies by default."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, keep_text: bool = False, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, then ids (array of int) and decoded (string) as asked for."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        digits = {i: str(i) for i in bpe.tokens}
        encoded = Cache(bpe, lambda ids: " ".join([digits[i] for i in ids]))
        for batch in short(batches):
            rows: list[tuple] = []
            texts_ = [words_of(t or "") for t in batch.column(1).to_pylist()]
            for words in encoded.of(texts_):  # a run without white space has at least one token
                ids = " ".join(words)
                plain = bpe.decode_digits(words)
                rows.append((ids.count(" ") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(plain.encode()).hexdigest(), [int(i) for i in ids.split()] if keep_ids else None, plain if keep_text else None))
            n, a, b, ids_of, plain_of = zip(*rows) if rows else ((),) * 5
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                out.append(pa.array(plain_of, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return texts(docs).mapInArrow(run, schema)


