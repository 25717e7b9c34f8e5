"""Document fingerprints by spot signatures.

A signature is a common word (the anchor) with the chain of the next content words
behind it. A document's set of signatures is its fingerprint. Sets are partitioned by
length, so that two sets of Jaccard 0.75 lie in one partition or in neighbours; in a
partition an index over each set's first signatures gives the candidates, whose lengths
are checked before any signature is compared.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M64, mix, parts, spans_of
from .parity_join import jaccard_components

CHAIN = 3
#: Jaccard from which documents are near duplicates, as a fraction.
NUM, DEN = 3, 4
#: Anchors, frequent words of the corpus's languages.
ANCHORS = frozenset(
    "the of and a in to is that it for on was with be as by this are at from "
    "der die das und in von zu den mit sich auf für ist im dem ein eine "
    "de la le et les des du un une en est que pour dans qui "
    "el los y se las del por con su una".split()
)
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\"
_PARTITION = 0xA24BAED4963EE407
_STEP = np.uint64(0xD6E8FEB86659FD93)
_KEY, _ANCHOR, _CONTENT = np.uint64(~3 & ((1 << 64) - 1)), np.uint64(1), np.uint64(2)


_SPACE, _INNER = np.zeros(256, bool), np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_INNER[[*_EDGE.encode(), *np.flatnonzero(_SPACE)]] = False


#: The bytes of a number that a word of 0 to 8 bytes fills.
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: one of up to 8 bytes is a number itself, mixed with its length; longer ones are hashed by xxh3."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    numbers = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the 8 bytes from every place on
    h = mix((numbers[start] & _FILLED[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
    long = np.flatnonzero(size > 8)
    if len(long):
        raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        h[long] = np.array([digest(raw[i:j]) for i, j in zip(start[long].tolist(), end[long].tolist())], np.uint64)
    return h


def _whole(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(w) for w in raw])
    return _hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], end[:-1]]), end)


_ANCHOR_HASHES = np.sort(_whole(sorted(ANCHORS)) & _KEY)


def tokens(text: str) -> np.ndarray:
    """The words of a text in order: 62 bits of hash; bit 0: anchor, bit 1: content word (neither: only signs)."""
    text = text.lower()
    if not text.isascii():
        text = " ".join(text.split())  # white space beyond ASCII
    data = np.frombuffer(text.encode(), np.uint8)
    start, end = spans_of(~_SPACE[data])
    if not len(start):
        return np.empty(0, np.uint64)
    inner = np.flatnonzero(_INNER[data])  # without signs at the edges of words
    first, last = np.searchsorted(inner, start), np.searchsorted(inner, end) - 1
    some = first <= last
    a, z = start.copy(), start.copy()
    a[some], z[some] = inner[first[some]], inner[last[some]] + 1
    h = _hashes(data, a, z) & _KEY
    at = np.minimum(np.searchsorted(_ANCHOR_HASHES, h), len(_ANCHOR_HASHES) - 1)
    anchor = some & (_ANCHOR_HASHES[at] == h)
    return h | np.where(anchor, _ANCHOR, np.where(some, _CONTENT, np.uint64(0)))


def edited_tokens(text: str, v: np.ndarray, keep: int, more: str, w: np.ndarray, cut: int) -> np.ndarray:
    """Words of ``text[:keep] + more[:cut]`` from those of both texts; only words at the cuts are looked up again."""
    a, b = text[:keep], more[:cut]
    left, right = a.split(), b.split()
    seam = left[-1:] + right[:1]
    if len(seam) == 2 and not a[-1].isspace() and not b[0].isspace():
        seam = ["".join(seam)]
    edges = tokens(" ".join([*seam, *right[1:][-1:]]))  # a token for each word
    return np.concatenate([v[: max(0, len(left) - 1)], edges[: len(seam)], w[1 : max(1, len(right) - 1)], edges[len(seam) :]])


def signatures(text: str | None, chain: int = CHAIN, v: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a whole text (``v``: its words, if they are known).

    Where no common word starts a full chain, every content word is an anchor. A text
    without any chain has one signature, a hash of all of it, so that it is like equal
    texts only; the empty text too.
    """
    text = text or ""
    v = tokens(text) if v is None else v
    at, body = np.flatnonzero(v & _ANCHOR), np.flatnonzero(v & _CONTENT)
    first = np.searchsorted(body, at)
    full = first + chain <= len(body)
    at, first = at[full], first[full]
    if not len(at):
        at, first = body[:-chain], np.arange(1, max(1, len(body) - chain + 1))
    if not len(at):
        return np.array([xxhash.xxh32_intdigest(text.encode())], np.uint32)
    h = v[at] & _KEY
    for k in range(chain):
        h = h * _STEP + (v[body[first + k]] & _KEY)
    return np.unique((mix(h) >> np.uint64(32)).astype(np.uint32))


def to_text(s: np.ndarray) -> str:
    """A fingerprint as a string: eight hex digits a signature, ascending."""
    return s.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two signature sets."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _edges() -> list[int]:
    """Smallest lengths of the partitions: a set and any that it can be linked with differ by one partition at most."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * DEN // NUM + 1))
    return edges


_EDGES = _edges()


def partition(n: int) -> int:
    return bisect_right(_EDGES, n) - 1


def index_keys(s: np.ndarray) -> np.ndarray:
    """Index entries of a set: its first signatures, in its own partition and, as the shorter set, in the next.

    Two sets of Jaccard 0.75 share more of their signatures than a quarter of either leaves out,
    so one of the first quarter (and one more) is common to both.
    """
    first = s[: len(s) * (DEN - NUM) // DEN + 1]
    k = partition(len(s))
    return np.concatenate([mix(first + np.uint64((k + d) * _PARTITION & M64), 21) for d in (0, 1)])


def _set(text: str | None) -> np.ndarray:
    return signatures(text).astype(np.uint64) if text and text.strip() else np.empty(0, np.uint64)


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(np.uint64)


def _narrow(s: np.ndarray) -> bytes:
    return s.astype(np.uint32).tobytes()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_signatures, component_id``: documents whose signature sets have Jaccard >= 0.75, linked.

    Exact for these sets of 32-bit signatures: candidates come from the index of each length partition, are pruned by their lengths and a bound
    of the symmetric difference, then the sets are compared. Blank texts link with nothing; rows are treated as
    in :func:`parity_join.jaccard_components`.
    """
    return jaccard_components(docs, _set, index_keys, (_narrow, _wide)).withColumnRenamed("n_shingles", "n_signatures")


_LOW = int(np.iinfo(np.int64).min)


def _ordered(docs: DataFrame, near: DataFrame) -> DataFrame:
    """Rows dealt to ranges of the order, with each range's successor as a last row (``tail``).

    The order is falling doc_id, then rows without doc_id; ties follow the hash of the text. Ranges
    hold equal numbers of ids (rows without doc_id are cut by hash), a partition each; the driver sees one
    boundary and one first row for each range. ``near`` (doc_id, component_id) comes as rows without text
    (kind 0) before the texts of its doc_id.
    """
    p = parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / p for k in range(1, p)] or [0.5], 10_000).alias("q")).first()["q"]
    bounds = np.unique(np.array(bounds or [], np.int64))
    n, step = len(bounds) + 1, (1 << 64) // p + 1

    def place(batches):
        for b in batches:
            ids, h = b.column(0), b.column(1).to_numpy()
            known = len(bounds) - np.searchsorted(bounds, ids.fill_null(_LOW).to_numpy(zero_copy_only=False), side="left")
            without = n + ((h.view(np.uint64) ^ np.uint64(1 << 63)) // np.uint64(step)).astype(np.int64)
            part = np.where(ids.is_null().to_numpy(zero_copy_only=False), without, known).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    placed = rows.select("doc_id", "h", "text").mapInArrow(place, "doc_id long, h long, text string, part int")
    heads = rows.select("doc_id", "h").mapInArrow(place, "doc_id long, h long, part int")
    # falling doc_id as a rising number; rows without doc_id are in parts of their own
    first = heads.groupBy("part").agg(F.min(F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(_LOW))).alias("id"), "h")).alias("x")).select("part", "x.id", "x.h")
    first = sorted(map(tuple, first.collect()))
    before = [(first[k - 1][0], part, ~key if part < n else None, h) for k, (part, key, h) in enumerate(first)]
    spark = docs.sparkSession
    want = F.broadcast(spark.createDataFrame(before, "to int, part int, id long, hash long"))  # a row for each range
    same = (placed["part"] == want["part"]) & placed["doc_id"].eqNullSafe(want["id"]) & (placed["h"] == want["hash"])
    tails = placed.join(want, same).select("doc_id", "h", "text", F.col("to").alias("part")).dropDuplicates(["part"])
    no = F.lit(None)
    comp = near.where("doc_id is not null").select("doc_id", F.lit(0).cast("long").alias("h"), no.cast("string").alias("text"), "component_id").mapInArrow(place, "doc_id long, h long, text string, component_id long, part int")
    every = placed.select("part", F.lit(0).alias("tail"), "doc_id", F.lit(1).alias("kind"), "h", "text", no.cast("long").alias("component_id"))
    every = every.union(tails.select("part", F.lit(1), "doc_id", F.lit(1), "h", "text", no.cast("long")))
    every = every.union(comp.select("part", F.lit(0), "doc_id", F.lit(0), "h", "text", "component_id"))
    return every.repartitionById(n + p, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "kind", "h")


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """``doc_id, fingerprint, n_signatures``, one row per input row; null texts count as empty."""

    def run(batches):
        for b in batches:
            s = [signatures(t, chain) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(to_text, s), pa.string()), pa.array(map(len, s), pa.int64())], ["doc_id", "fingerprint", "n_signatures"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string, n_signatures long")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    The edit replaces the last third of the code points by the beginning of the next
    document (falling doc_id; after the last one comes the first). One shuffle of the
    texts; each text is fingerprinted once as itself and once edited. ``component_id``: smallest doc_id that is linked by near
    duplicates (see :func:`near_duplicates`).

    Null texts count as empty. Rows without doc_id come last and have no component. Rows of one doc_id
    follow each other by the hash of their text; equal rows stay as many. Other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"]
    kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2 + [pa.int64()]

    def run(batches):
        held = comp = None  # held: part, doc_id, text, words, signatures, component of the row that waits for its successor
        for b in batches:
            out = []
            for part, tail, doc, kind, text, component in zip(*(b.column(c).to_pylist() for c in ("part", "tail", "doc_id", "kind", "text", "component_id"))):
                if kind == 0:
                    comp = (doc, component)
                    continue
                v = tokens(text)
                own = signatures(text, v=v)
                if held is not None and held[0] == part:
                    _, h_doc, h_text, h_v, h_own, h_comp = held
                    cut = len(h_text) // 3
                    keep = len(h_text) - cut
                    edited = h_text[:keep] + text[:cut]
                    e = signatures(edited, v=edited_tokens(h_text, h_v, keep, text, v, cut))
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((h_doc, len(h_text), digest, to_text(h_own), to_text(e), likeness(h_own, e), likeness(h_own, own), h_comp))
                held = None if tail else (part, doc, text, v, own, comp[1] if comp and comp[0] == doc else None)
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    near = near_duplicates(docs).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
    return _ordered(docs, near).mapInArrow(run, schema)
