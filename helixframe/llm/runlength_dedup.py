"""Exact removal of repeated 100-byte substrings with a run-length text index.

Every 100-byte window belongs to one segment: the run of windows that share the
same smallest 32-byte-gram hash (a minimizer). Equal windows have equal minimizers,
so all that can match meets under one key, wherever it lies.

1. Segments are dealt by key as packed bytes. Segments of equal content are one class;
   all but the earliest of a class are covered by it. That is the pre-aggregation:
   copies of any number leave one text.
2. Keys under which several texts meet (or a text that can repeat within itself) get a
   run-length index: suffix order, run-compressed Burrows-Wheeler transform, and, at the
   run ends only, sampled suffix positions with their predecessor and common prefix.
   Streaming over the text, each position takes its matching statistic (the place and
   length of its match) from the nearest sample before it. Matches of 100 bytes or more
   chain equal windows; every window but the earliest of its chain is marked.
   A key under which more than ``INDEX_CLASSES`` texts meet is split first: its texts are
   segmented again by another minimizer, as often as needed, so an index is always small.
3. A document's marked intervals are merged and cut out of its bytes.

Copies are combined in each task before the shuffle: of a content that is frequent there
only the earliest travels by its key. Contents are told apart by 128 bits of a hash whose seed is drawn for each run.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Packer, fresh, materialize, mix, parts, release, runs, unpack

LENGTH, GRAM = 100, 32
WINDOWS = LENGTH - GRAM + 1
#: Texts of a key from which it is split by a further minimizer.
INDEX_CLASSES = 1000
#: Records of a key in one flush from which its copies are combined there, and different texts from which it is split.
COMBINE, SPLIT = 16, 256
#: Splits of a key; what is left then is indexed whatever its size.
LEVELS = 16
CHUNK_BYTES = 1 << 17
#: Bytes of texts that a task holds before it indexes the whole keys among them.
HELD_BYTES = 1 << 23
#: The rolling hash of grams only deals segments to keys: multiplier and byte table.
_GRAM_BASE = 0x9E6C63D0876A9A47 | 1
_GRAM_TABLE = mix(np.arange(256, dtype=np.uint64), 77)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window of ``width`` by doubling."""
    span = 1
    while span * 2 <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return op(a[:-rest], a[rest:]) if rest else a


def segments(data: bytes, seed: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """key, 128 bits of the content's hash, start, number of windows, and whether a window may repeat inside."""
    n = len(data)
    if n < LENGTH:
        e = np.empty(0, np.uint64)
        return e, e, e, e.astype(np.int64), e.astype(np.int64), e.astype(bool)
    h, s = _GRAM_TABLE[np.frombuffer(data, np.uint8)], 1
    while s < GRAM:
        h = h[:-s] * np.uint64(pow(_GRAM_BASE, s, 1 << 64)) + h[s:]
        s *= 2
    h = mix(h, 5 + level)
    low = _slide(h, WINDOWS, np.minimum)
    a, w = runs(low)
    edge = np.zeros(WINDOWS - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), WINDOWS, np.maximum) == h)
    twice = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (np.diff(at) <= WINDOWS))
    again = np.zeros(len(a), bool)
    again[np.searchsorted(a, np.minimum(at[twice], len(low) - 1), side="right") - 1] = True
    digest = xxhash.xxh3_128_digest
    content = np.frombuffer(b"".join([digest(data[i:j], seed) for i, j in zip(a.tolist(), (a + w + LENGTH - 1).tolist())]), np.uint64)
    return low[a], content[::2], content[1::2], a, w, again


class RunLengthIndex:
    """Run-compressed BWT of a symbol array with samples at the run ends."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        code = np.zeros(n, np.int64)
        padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
        for k in range(7):
            code = (code << 9) | padded[k : k + n]
        levels, h = [], 7
        order, rank = self._ranked(code)
        levels.append((h, rank))
        while rank[order[-1]] < n - 1:
            second = np.zeros(n, np.int64)
            if h < n:
                second[:-h] = rank[h:].astype(np.int64) + 1
            order, rank = self._ranked(rank.astype(np.int64) * (n + 1) + second)
            h *= 2
            levels.append((h, rank))
        sa = order
        bwt = text[sa - 1].astype(np.int32)
        bwt[sa == 0] = -1
        head = np.concatenate([[0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1])
        self.run_start, self.run_symbol = head, bwt[head]
        pos, prev = sa[head], np.where(head > 0, sa[head - 1], -1)
        lcp = self._common(levels, pos, prev, text)
        by = np.argsort(pos)
        self.n, self.pos, self.prev, self.lcp = n, pos[by], prev[by], lcp[by]

    @staticmethod
    def _ranked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(code)
        rank = np.empty(len(code), np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(code[order]) != 0)])
        return order, rank

    @staticmethod
    def _common(levels, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffix pairs, by the ranks of the doubling rounds."""
        n = len(text)
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        ok = b >= 0
        for h, rank in reversed(levels):
            inside = ok & (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            out[same] += h
            a[same] += h
            b[same] += h
        going = ok
        for _ in range(levels[0][0] - 1):
            going = going & (a < n) & (b < n)
            going[going] = text[a[going]] == text[b[going]]
            out[going] += 1
            a[going] += 1
            b[going] += 1
        return out

    def matches(self, block: int = 1 << 16):
        """Streams ``(positions, match position, match length)`` in text order."""
        for lo in range(0, self.n, block):
            i = np.arange(lo, min(lo + block, self.n))
            s = np.searchsorted(self.pos, i, side="right") - 1
            yield i, self.prev[s] + (i - self.pos[s]), self.lcp[s] - (i - self.pos[s])


def repeated_windows(texts: list[bytes]) -> list[np.ndarray]:
    """For texts in order: starts of windows that also start earlier (in an earlier text, or before in the same)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.full(int(base[-1] + sizes[-1] + 1), 256, np.uint16)
    valid = np.zeros(len(text), bool)
    for t, s in zip(texts, base):
        text[s : s + len(t)] = np.frombuffer(t, np.uint8)
        valid[s : s + len(t) - LENGTH + 1] = True
    link = np.arange(len(text))
    for i, to, length in RunLengthIndex(text).matches():
        hit = (length >= LENGTH) & valid[i]
        link[i[hit]] = to[hit]
    while True:
        further = link[link]
        if (further == link).all():
            break
        link = further
    at = np.flatnonzero(valid)
    _, first, back = np.unique(link[at], return_index=True, return_inverse=True)
    late = at[at[first][back] != at]
    owner = np.searchsorted(base, late, side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [late[cut[j] : cut[j + 1]] - base[j] for j in range(len(texts))]


def _intervals(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of consecutive window starts as byte intervals."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + LENGTH


def _classes(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Records ``key, h1, h2, doc, start, windows`` sorted; which are the first of their content, which
    only repeat the first's place (repeated rows), and the number of contents of the record's key."""
    key, h1, h2, doc, a, w = cols
    order = np.lexsort((a, doc, h2, h1, key))
    key, h1, h2, doc, a, w = cols = [c[order] for c in cols]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    first = new_key.copy()
    first[1:] |= (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    group = np.cumsum(new_key) - 1
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    same = ~first & (doc == doc[lead]) & (a == a[lead])
    return cols, first, same, np.bincount(group, first & (w > 0))[group].astype(np.int64)


def _combine(cols: list[np.ndarray], often_from: int, split_from: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of contents that are frequent in a flush the earliest stays; the others are covered by it (set aside
    with key 0). A key with too many contents leaves a mark (no windows) and is set aside whole."""
    order = np.argsort(cols[0], kind="stable")
    starts, lens = runs(cols[0][order])
    often = np.repeat(lens > often_from, lens)
    if not often.any():
        return cols, []
    rare = [c[order[~often]] for c in cols]
    some, first, same, classes = _classes([c[order[often]] for c in cols])
    covered, split = ~first & ~same, first & (classes > split_from)
    stay = [np.concatenate([r, c[first & ~split]]) for r, c in zip(rare, some)]
    marks = np.unique(some[0][split])
    zero = np.zeros(len(marks), np.uint64)
    stay = [np.concatenate([c, m.astype(c.dtype)]) for c, m in zip(stay, (marks, zero, zero, zero, zero, zero))]
    out = covered | split
    aside = [c[out] for c in some]
    aside[0] = np.where(covered[out], np.uint64(0), aside[0])
    aside[1] = aside[3].view(np.uint64)  # dealt by document
    return stay, aside if out.any() else []


_RECORD = [np.uint64, np.uint64, np.uint64, np.int64, np.uint32, np.uint32]


def _found(docs: DataFrame, p: int, seed: int) -> DataFrame:
    """``doc_id, lo, hi, key, kind``: 0 covered bytes, 1 texts for the index, 2 texts of keys to be split."""

    bounds = COMBINE, SPLIT

    def deal(batches):
        pack = Packer(4 * p, limit=500_000, split=lambda cols: _combine(cols, *bounds))
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, h1, h2, a, w, again = segments((text or "").encode(), seed)
                if len(key):
                    yield from pack.add(key, h1, h2, np.full(len(key), doc, np.int64), a.astype(np.uint32), (w.astype(np.uint32) << np.uint32(1)) | again.astype(np.uint32))
        yield from pack.flush()

    def send(key, doc, a, w, kind):
        for i in range(0, len(doc), 100_000):
            o = slice(i, i + 100_000)
            lo = a[o].astype(np.int64)
            hi = lo + (w[o] >> np.uint32(1)) + LENGTH - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[o]), pa.array(lo), pa.array(hi), pa.array(key[o].view(np.int64)), pa.array(kind[o])], ["doc_id", "lo", "hi", "key", "kind"])

    def meet(batches):
        kept = []
        for b in batches:
            own = b.column("bucket").to_numpy() >= 0
            aside = b.filter(pa.array(~own))
            if aside.num_rows:
                key, _, _, doc, a, w = unpack([aside], _RECORD)
                yield from send(key, doc, a, w, np.where(key == 0, 0, 2).astype(np.int32))
            kept.append(b.filter(pa.array(own)))
        cols = unpack(kept, _RECORD)
        if not len(cols[0]):
            return
        (key, _, _, doc, a, w), first, same, classes = _classes(cols)
        marked = np.isin(key, np.unique(key[w == 0]))
        kind = np.full(len(key), -1, np.int32)
        kind[~first & ~same] = 0
        kind[first & ((classes > 1) | (w & 1 == 1))] = 1
        kind[first & ((classes > INDEX_CLASSES) | marked)] = 2
        out = np.flatnonzero((kind >= 0) & (w > 0))
        yield from send(key[out], doc[out], a[out], w[out], kind[out])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(deal, Packer.schema(6)).repartitionById(p, F.pmod("bucket", F.lit(p))).mapInArrow(meet, "doc_id long, lo long, hi long, key long, kind int")


def _texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``key, kind, doc_id, lo, body``: the bytes of the segments that have to be compared."""
    want = found.where("kind > 0").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "key", "kind")).alias("segs"))

    def cut(batches):
        for b in batches:
            out = []
            for doc, text, segs in zip(*(b.column(k).to_pylist() for k in range(3))):
                data = (text or "").encode()
                out += [(s["key"], s["kind"], doc, s["lo"], x) for s in segs if len(x := data[s["lo"] : s["hi"]]) >= LENGTH]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["key", "kind", "doc_id", "lo", "body"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(want, "doc_id")
    return rows.mapInArrow(cut, "key long, kind int, doc_id long, lo long, body binary")


def _indexed(texts: DataFrame, p: int) -> DataFrame:
    """``doc_id, lo, hi``: intervals marked by run-length indexes over chunks of whole keys."""

    def chunks(t: pa.Table):
        key, doc, lo = (t.column(c).to_numpy() for c in ("key", "doc_id", "lo"))
        order = np.lexsort((lo, doc, key))
        k, d, a = key[order], doc[order], lo[order]
        order = order[np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1])])]  # repeated rows
        body = t.column("body").take(pa.array(order)).to_pylist()
        key, doc, lo = key[order], doc[order], lo[order]
        size, cuts = 0, [0]
        for s, m in zip(*runs(key)):
            size += sum(map(len, body[s : s + m]))
            if size >= CHUNK_BYTES:
                cuts.append(s + m)
                size = 0
        if cuts[-1] != len(key):
            cuts.append(len(key))
        for x, y in zip(cuts, cuts[1:]):
            d, a, e = [], [], []
            for j, late in enumerate(repeated_windows(body[x:y])):
                if len(late):
                    b, c = _intervals(late)
                    d.append(np.full(len(b), doc[x + j]))
                    a.append(b + lo[x + j])
                    e.append(c + lo[x + j])
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (d, a, e)], ["doc_id", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size >= HELD_BYTES:  # all but the last key, which may go on
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                cut = len(key) - int((key[::-1] != key[-1]).argmax()) if key[0] != key[-1] else 0
                if cut:
                    yield from chunks(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from chunks(pa.Table.from_batches(held).combine_chunks())

    rows = texts.where("kind = 1").select("key", "doc_id", "lo", "body").repartition(p, "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "doc_id long, lo long, hi long")


def _split(texts: DataFrame, level: int, seed: int) -> DataFrame:
    """``key, kind, doc_id, lo, body`` of texts segmented again by another minimizer; kinds as in :func:`_found`."""

    def run(batches):
        for b in batches:
            cols, bodies = [], []
            for key, doc, lo, body in zip(*(b.column(k).to_pylist() for k in range(4))):
                k, h1, h2, a, w, again = segments(body, seed, level)
                k = mix(k ^ mix(np.array([key], np.int64).view(np.uint64), level))
                cols.append((k.view(np.int64), h1.view(np.int64), h2.view(np.int64), np.full(len(k), doc), a + lo, again))
                bodies += [body[x : x + y + LENGTH - 1] for x, y in zip(a, w)]
            if bodies:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in zip(*cols)), pa.array(bodies, pa.binary())], ["key", "h1", "h2", "doc_id", "lo", "again", "body"])

    parts_ = materialize(texts.select("key", "doc_id", "lo", "body").mapInArrow(run, "key long, h1 long, h2 long, doc_id long, lo long, again boolean, body binary"), "dedup-split")
    first = parts_.groupBy("key", "h1", "h2").agg(F.min(F.struct("doc_id", "lo")).alias("first"))
    size = first.groupBy("key").agg(F.count("*").alias("classes"))
    rows = parts_.join(first, ["key", "h1", "h2"]).join(size, "key")
    late = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("lo") != F.col("first.lo"))
    kind = F.when(late, 0).when((F.col("classes") > INDEX_CLASSES) & F.lit(level < LEVELS), 2).when((F.col("classes") > 1) | F.col("again"), 1)
    out = materialize(rows.select("key", kind.alias("kind"), "doc_id", "lo", "body").where("kind is not null"), "dedup-texts")
    release(parts_)
    return out


def removed_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: unmerged byte intervals to remove, only documents that have some."""
    p = parts(docs.sparkSession)
    seed = secrets.randbits(64)
    found = materialize(_found(docs, p, seed), "dedup-found")
    texts = materialize(_texts(docs, found), "dedup-texts")
    marks, made = found.where("kind = 0").select("doc_id", "lo", "hi"), [found, texts]
    for level in range(1, LEVELS + 1):
        marks = marks.union(_indexed(texts, p))
        rest = texts.where("kind = 2")
        if not rest.limit(1).count():
            break
        texts = _split(rest, level, seed)
        made.append(texts)
        marks = marks.union(texts.where("kind = 0").select("doc_id", "lo", (F.col("lo") + F.length("body")).alias("hi")))
    else:
        marks = marks.union(_indexed(texts, p))
    marks = materialize(marks, "dedup-marks")
    release(*made)
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut_spans(data: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """Remaining bytes and the maximal removed intervals, clipped to the text."""
    if not spans:
        return data, []
    merged: list[list[int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], len(data))) for s in spans):
        if hi <= lo:
            continue
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    kept, at = [], 0
    for lo, hi in merged:
        kept.append(data[at:lo])
        at = hi
    kept.append(data[at:])
    return b"".join(kept), [tuple(m) for m in merged]


def dedup_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row.

    Null and empty texts have no bytes. Rows that repeat a doc_id are one document;
    should their texts differ, each loses the union of their spans. Rows without
    doc_id take no part and keep everything.
    """

    def run(batches):
        for b in batches:
            out = []
            for doc, text, spans in zip(*(b.column(k).to_pylist() for k in range(3))):
                data = (text or "").encode()
                kept, cuts = cut_spans(data, spans)
                out.append((doc, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(removed_spans(docs), "doc_id", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and ``n_chars`` set anew; all rows stay.

    A character of which a cut leaves only some bytes is dropped. Null texts stay null.
    """
    cols = docs.columns
    at, last = cols.index("text"), len(cols)
    doc, spans = fresh(cols, "doc"), fresh(cols, "spans")

    def run(batches):
        for b in batches:
            texts, cuts = b.column(at).to_pylist(), b.column(last).to_pylist()
            new = [t if t is None or not s else cut_spans(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, cuts)]
            arrays = [pa.array(new, pa.string()) if k == at else pa.array([None if t is None else len(t) for t in new], pa.int64()) if c == "n_chars" else b.column(k) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, cols)

    cut = removed_spans(docs).withColumnsRenamed({"doc_id": doc, "spans": spans})
    out = docs.join(cut, docs["doc_id"].cast("long") == cut[doc], "left").select(*[F.col(f"`{c}`") for c in cols], spans)
    schema = docs.select(*[F.col(f"`{c}`").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in cols]).schema
    return out.mapInArrow(run, schema)
