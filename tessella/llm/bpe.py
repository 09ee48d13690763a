"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that is inside no vocabulary token can never end up within one token, so wherever it occurs the text
can be cut, the fragments encoded on their own and their ids put end to end. Fragments recur, so each worker
remembers them; a fragment's merges run over a heap, in n log n, however long it is.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: The usual pre-tokenisation of byte-level vocabularies: merges don't cross the borders of these matches.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The same by the faster re, for texts without a character of _SLOW (numbers that aren't decimal digits) and without the four separators that only re takes for white space.
_FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_SLOW = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))
_FULL = regex.compile(PATTERN).findall
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 400_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def forced_boundaries(tokens) -> np.ndarray:
    """256 x 256: true where the pair of bytes is inside no token."""
    cut = np.ones((256, 256), bool)
    for t in tokens:
        for a, b in zip(t, t[1:]):
            cut[a, b] = False
    return cut


def pre_tokens(text: str) -> list[str]:
    slow = any(c in text for c in "\x1c\x1d\x1e\x1f") or not (text.isascii() or _SLOW.isdisjoint(text))
    return (_FULL if slow else _FAST)(text)


class Codec(dict):
    """Maps a pre-token (str) to its ids as int32 bytes; misses are computed, and kept while there is room."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.cut = forced_boundaries(ranks)
        self.forced = set(map(tuple, np.argwhere(self.cut).tolist()))
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.sizes[k] = len(token)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self.fragments: dict[bytes, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        if (whole := self.ranks.get(raw)) is not None:
            ids = whole.to_bytes(4, "little")
        else:
            parts = self.split(raw)
            ids = b"".join(map(self.fragment, parts)) if len(parts) > 1 else array("i", self.merge(raw)).tobytes()
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = ids
        return ids

    def split(self, raw: bytes) -> list[bytes]:
        if len(raw) > 64:
            v = np.frombuffer(raw, np.uint8)
            at = (np.flatnonzero(self.cut[v[:-1], v[1:]]) + 1).tolist()
        else:
            pairs = self.forced
            at = [k + 1 for k, pair in enumerate(zip(raw, raw[1:])) if pair in pairs]
            if not at:
                return [raw]
        return [raw[a:b] for a, b in zip([0, *at], [*at, len(raw)])]

    def fragment(self, raw: bytes) -> bytes:
        if (found := self.fragments.get(raw)) is None:
            found = array("i", self.merge(raw)).tobytes()
            if len(self.fragments) < REMEMBERED and len(raw) < 64:
                self.fragments[raw] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Merges the pair of least rank, the leftmost of equals, until none is in the vocabulary."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        if n <= 48:
            at, none = list(range(n + 1)), 1 << 60
            rank = [ranks.get(raw[k : k + 2], none) for k in range(n - 1)]
            while rank and (least := min(rank)) < none:
                k = rank.index(least)
                del at[k + 1], rank[k]
                if k < len(rank):
                    rank[k] = ranks.get(raw[at[k] : at[k + 2]], none)
                if k:
                    rank[k - 1] = ranks.get(raw[at[k - 1] : at[k + 1]], none)
            return [ranks[raw[a:b]] for a, b in zip(at, at[1:])]
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(raw[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, k, stop = heappop(heap)
            nxt = after[k] if end[k] > 0 else n
            if end[k] <= 0 or nxt >= n or end[nxt] != stop:
                continue
            end[k], end[nxt] = stop, 0
            after[k] = nxt2 = after[nxt]
            if nxt2 < n:
                before[nxt2] = k
                if (r := ranks.get(raw[k : end[nxt2]])) is not None:
                    heappush(heap, (r, k, end[nxt2]))
            if (p := before[k]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[raw[k : end[k]]])
            k = after[k]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pre_tokens(text)))

    def decode(self, ids: np.ndarray) -> str:
        """Gathers the tokens' bytes with numpy."""
        if not len(ids):
            return ""
        size = self.sizes[ids]
        if not size.all():
            raise ValueError("an id isn't in the vocabulary")
        end = np.cumsum(size)
        at = np.repeat(self.places[ids] - (end - size), size) + np.arange(end[-1])
        return self.bytes[at].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(read_vocabulary(path))
    return _CODECS[path]


def _int_lists(ids: list[bytes | None]) -> pa.Array:
    sizes = np.array([0 if x is None else len(x) // 4 for x in ids], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.frombuffer(b"".join(x for x in ids if x), np.int32)
    null = pa.array([x is None for x in ids])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=null) if len(ids) else pa.array([], pa.list_(pa.int32()))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row of docs.

    A null text has null token_ids and n_tokens, an empty one an empty list and 0. Repeated rows are encoded each;
    other columns are dropped. Strings of special tokens are ordinary text.
    """

    def run(batches):
        c = codec(vocabulary)
        for b in _slices(batches, 256):
            ids = [None if t is None else c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else len(x) // 4 for x in ids], pa.int32()), _int_lists(ids)], ["doc_id", "n_tokens", "token_ids"])

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens int, token_ids array<int>")


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, id: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(doc_id, text) from lists of ids; null lists give null, an unknown id is an error."""

    def run(batches):
        c = codec(vocabulary)
        for b in _slices(batches, 256):
            text = [None if x is None else c.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = dict(tokens.dtypes)[id]
    return tokens.select(F.col(id).alias("doc_id"), F.col(ids).alias("token_ids")).mapInArrow(run, f"doc_id {kind}, text string")


def encode_checked(docs: DataFrame, vocabulary: str = VOCABULARY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """encode(), and round_trip: whether decoding the ids gives the text again (null for a null text)."""

    def run(batches):
        c = codec(vocabulary)
        for b in _slices(batches, 256):
            texts = b.column(1).to_pylist()
            ids = [None if t is None else c.encode(t) for t in texts]
            same = [None if t is None else c.decode(np.frombuffer(x, np.int32)) == t for t, x in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if x is None else len(x) // 4 for x in ids], pa.int32()), _int_lists(ids), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"]
            )

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens int, token_ids array<int>, round_trip boolean")
