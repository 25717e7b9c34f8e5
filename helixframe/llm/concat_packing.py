"""Packing: concatenate all documents and cut the stream into fixed windows.

Pass 1 encodes every text where it lies, writes the packed ids with their offset
inside the input partition, and thereby fixes the order of the stream. Prefix sums
over the partitions' token totals (one number per partition) turn local offsets
into global ones; pass 2 cuts each document at multiples of the window length. No
row is shuffled. The padding is that of the last sequence only.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import ChunkedEncoder, load_ranks
from .common import materialize

WINDOW = 1024
END_ID = 0


class Encoder:
    """Ids of a text as the tokenizer file's own library gives them: added tokens (``added``: text to id) are
    found first, leftmost, the longest of several, and what lies between them is encoded by itself."""

    def __init__(self, path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        self.chunks = ChunkedEncoder(lambda s: np.array(enc.encode_ordinary(s), "<u4").tobytes())
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str) -> bytes:
        if not self.cut or not any(t in text for t in self.added):
            return self.chunks.encode(text)
        return b"".join(self.added[x] if x in self.added else self.chunks.encode(x) for x in self.cut.split(text))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> Encoder:
    return Encoder(path, pattern, dict(added))


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file; flags that change the text around a token are not known here."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("added tokens that strip or need whole words are not supported")
    return {t["content"]: t["id"] for t in tokens}


def tokenize(docs: DataFrame, path: str, pattern: str, added: dict[str, int] | None = None) -> DataFrame:
    """``part, local, doc_id, doc_tokens, ids``: ids end with ``END_ID``; local = ids before it in its partition."""
    extra = tuple(sorted((added or {}).items()))

    def run(batches):
        enc, at, part = _encoder(path, pattern, extra), 0, TaskContext.get().partitionId()
        tail = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                ids = [enc.encode(t or "") + tail for t in b.column(1).slice(lo, 1000).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(local), b.column(0).slice(lo, 1000), pa.array(n), pa.array(ids, pa.binary())], ["part", "local", "doc_id", "doc_tokens", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "part int, local long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, pattern: str, added: dict[str, int] | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Sequences are gapless from offset 0, and only the last one can be short. A null or
    empty text is one end id; a text that holds one of the ``added`` tokens has that token's id there; repeated rows are packed once each; no rows, no pieces.
    The table of partition totals has one row per input partition.
    """
    coded = materialize(tokenize(docs, path, pattern, added), "packing")
    totals = coded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = coded.join(F.broadcast(base), "part").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("local")).alias("at"))

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                out: list[tuple] = []
                for doc, total, ids, at in zip(*(part.column(k).to_pylist() for k in range(4))):
                    start = 0
                    while start < total:
                        n = min(total - start, window - (at + start) % window)
                        piece = ids[4 * start : 4 * (start + n)]
                        out.append((doc, start, n, zlib.crc32(piece), total, (at + start) // window, (at + start) % window, piece))
                        start += n
                cols = list(zip(*out)) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
