"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1 is a minimal perfect hash (hash and displace) over the vocabulary: a
pre-token that is a vocabulary entry is resolved by one probe and one comparison.
Tier 2 merges the bytes of every other pre-token: a doubly linked list of pieces
with a heap of candidate pairs ordered by (rank, position), O(n log n).

A bounded memo in front keeps the ids of space-delimited chunks. A chunk may be
cut before a single space between two non-space characters, because no match of
the split pattern reaches over such a place.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_ENTRIES = 400_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


class PerfectHash:
    """Minimal perfect hash of distinct byte strings; ``get`` gives the value or -1."""

    def __init__(self, items: dict[bytes, int]):
        self.n = n = max(1, len(items))
        self.nb = max(1, n // 2)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in items:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.nb, []).append((h, key))
        self.shift = [0] * self.nb
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        singles = []
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                singles.append((b, members[0][1]))
                continue
            d = 0
            while True:
                slots = {((h >> 17) + d * ((h >> 37) | 1)) % n for h, _ in members}
                if len(slots) == len(members) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for h, key in members:
                s = ((h >> 17) + d * ((h >> 37) | 1)) % n
                self.keys[s], self.values[s] = key, items[key]
        free = (s for s in range(n) if self.keys[s] is None)
        for b, key in singles:  # a bucket of one names its slot outright, as -1 - slot
            s = next(free)
            self.shift[b] = -1 - s
            self.keys[s], self.values[s] = key, items[key]

    def get(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.nb]
        s = -1 - d if d < 0 else ((h >> 17) + d * ((h >> 37) | 1)) % self.n
        return self.values[s] if self.keys[s] == key else -1


class _Memo(dict):
    """chunk without its leading space -> little-endian uint32 ids; KeyError at an unsafe cut."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise KeyError(chunk)
        ids = self.encode(" " + chunk)
        if len(chunk) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids


class ChunkedEncoder:
    """Encodes whole texts chunk by chunk; ``encode_piece`` maps a str to packed ids."""

    def __init__(self, encode_piece, limit: int = MEMO_ENTRIES):
        self.encode_piece, self.memo = encode_piece, _Memo(encode_piece, limit)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ")
        get = self.memo.__getitem__
        first = pieces[0]
        try:
            if not first or first[-1].isspace():
                raise KeyError(first)
            return b"".join([self.encode_piece(first), *map(get, pieces[1:])])
        except KeyError:
            head, *rest = _CUT.split(text)
            return b"".join([self.encode_piece(head), *(get(c) if not (c[0].isspace() or c[-1].isspace()) else self.encode_piece(" " + c) for c in rest)])


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO_ENTRIES):
        self.ranks, self.table, self.pattern = ranks, PerfectHash(ranks), regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.chunks = ChunkedEncoder(self.piece, memo)

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary; the lowest rank merges first, leftmost on ties."""
        n, rank = len(data), self.ranks.get
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # piece i is data[i:end[i]]; end[i] starts the next one
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n + [False]
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := rank(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> bytes:
        ids: list[int] = []
        for token in self.pattern.findall(text):
            data = token.encode()
            i = self.table.get(data)
            if i >= 0:
                ids.append(i)
            else:
                ids += self.merge(data)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Packed little-endian uint32 ids of a whole text (null: none)."""
        return self.chunks.encode(text or "")

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian uint32) of every whole text; null texts give no ids."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes that the ids stand for."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def roundtrip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest every row in one pass over the texts.

    One row per input row, whatever its id: nulls and empty texts have no tokens,
    repeated rows repeat. Extra columns are ignored.
    """

    def run(batches):
        c = codec(path, pattern)
        dec = c.decimal
        for b in batches:
            n, sha, back = [], [], []
            for text in b.column(1).to_pylist():
                ids = np.frombuffer(c.encode(text), "<u4").tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(" ".join([dec[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
