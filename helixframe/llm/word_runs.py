"""Runs of periodic words from the longest-previous-factor array.

Words become numbers, and ranks of all substrings of 2^k words give the suffix array, exact longest
common extensions in both directions, and with these the LCP of neighbours. The nearest
smaller suffix on either side gives each position's longest previous factor, and greedy steps along it the
Lempel-Ziv blocks. A run touches the border of a block or repeats, wholly inside a block, a run
of the block's earlier copy: the first kind is found by extending possible periods at every border,
the second is copied block by block, with runs in buckets by their start.

Documents are independent, so they are never shuffled. Short documents share one set of arrays, in which
their words are numbered apart; arrays take about 4 bytes a word and level.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose documents share one set of arrays.
CHUNK_WORDS = 50_000
MIN_LENGTH, EXPONENT = 6, 4

Run = tuple[int, int, int]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the sorted distinct keys at every place, and the order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) if len(k) else 0
    return rank, order


class Suffixes:
    """Suffix order of documents laid one after the other; ``doc`` numbers them, ascending.

    ``levels[k]`` are ranks by the first 2^k words. Places whose rank is theirs alone keep it, so
    only the others are sorted again. Equal ranks at two places mean equal 2^k words inside one document.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = self.n = len(words)
        first, end = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
        self.first, self.end = first, end
        rank, order = _ranked(doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
        # a rank is the number of suffixes before its class, so a class can be split without moving others
        low = np.searchsorted(rank[order], np.arange(rank.max(initial=0) + 1))
        rank = low[rank]
        self.levels = [rank.astype(np.int32)]
        size = np.bincount(rank, minlength=n)
        live = np.flatnonzero(size[rank] > 1)
        step = 1
        while len(live):
            after = live + step
            inside = after < end[live]
            # suffixes that end here come first, the shorter the earlier
            tail = np.where(inside, rank[np.minimum(after, n - 1)] + n + 1, end[live] - live)
            by = np.lexsort([tail, rank[live]])
            at, r, t = live[by], rank[live][by], tail[by]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])])
            group = np.concatenate([[True], r[1:] != r[:-1]])
            place = np.arange(len(at))
            rank = rank.copy()
            rank[at] = r + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
            self.levels.append(rank.astype(np.int32))
            size = np.diff(np.append(np.flatnonzero(new), len(at)))
            live = np.sort(at[np.repeat(size, size) > 1])
            step *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` on; a < b in one document, or b its end. No two places agree at the highest level."""
        x, y = a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            r = self.levels[k]
            same = (y < self.end[a]) & (r[np.minimum(x, self.n - 1)] == r[np.minimum(y, self.n - 1)])
            x, y = x + (same << k), y + (same << k)
        return x - a

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before ``a`` and ``b``; a < b in one document, or b its end."""
        x, y, first = a.copy(), b.copy(), self.first[a]
        for k in range(len(self.levels) - 1, -1, -1):
            r, step = self.levels[k], 1 << k
            same = (x - step >= first) & (r[np.maximum(x - step, 0)] == r[np.maximum(y - step, 0)])
            x, y = x - same * step, y - same * step
        return a - x


def _nearest_smaller(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the nearest smaller place before and behind it in ``order``, or -1."""
    before, behind = [-1] * len(order), [-1] * len(order)
    stack = [-1]
    for v in order.tolist():
        while stack[-1] > v:
            behind[stack.pop()] = v
        before[v] = stack[-1]
        stack.append(v)
    return np.array(before, np.int64), np.array(behind, np.int64)


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of every place: its length and an earlier place where it stands."""
    lpf, source = np.zeros(s.n, np.int64), np.full(s.n, -1)
    for near in _nearest_smaller(s.order):
        at = np.flatnonzero(near >= s.first)
        length = s.ahead(near[at], at)
        better = length > lpf[at]
        lpf[at[better]], source[at[better]] = length[better], near[at[better]]
    return lpf, source


def _blocks(lpf: np.ndarray, lo: int, hi: int) -> list[int]:
    """Starts of the Lempel-Ziv blocks of the document [lo, hi), and its end."""
    step = np.maximum(lpf[lo:hi], 1).tolist()
    at, out = 0, []
    while at < len(step):
        out.append(at)
        at += step[at]
    return [*out, len(step)]


def enumerate_runs(words: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[Run]]:
    """``(start, length, period)`` of all runs of every document, by start, then period.

    ``words``: numbers of the words of all documents, one after the other; ``ends``: where each ends.
    A run has its smallest period, at least ``exponent`` (2 or more) times, at least ``min_length`` words, and no
    neighbour that extends it.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(ends)), ends - starts)
    found: list[dict[tuple[int, int], int]] = [{} for _ in ends]
    if not len(words):
        return [[] for _ in ends]
    s = Suffixes(words, doc)
    lpf, source = previous_factors(s)

    cuts = [np.array(_blocks(lpf, lo, hi), np.int64) + lo if hi > lo else np.empty(0, np.int64) for lo, hi in zip(starts.tolist(), ends.tolist())]
    border = np.concatenate([c[1:] for c in cuts])
    last = np.concatenate([np.diff(c) for c in cuts])  # length of the block before the border
    after = np.concatenate([np.append(np.diff(c)[1:], 0) if len(c) else c for c in cuts])
    of = np.repeat(np.arange(len(cuts)), [max(0, len(c) - 1) for c in cuts])

    # Behind its first period a run has exponent - 1 more. The first border there lies inside the run, or the
    # run ends before it: so it spans that border, or begins at or before the border in front and ends inside that block.
    for room, side in ((last + after, -1), (after, 1)):
        most = room // (exponent - 1)
        b, p, d = np.repeat(border, most), _counted(most) + 1, np.repeat(of, most)
        a = b - p if side < 0 else b
        fits = (a >= starts[d]) & (a + p <= ends[d])
        a, p, d = a[fits], p[fits], d[fits]
        ahead = (a + p < ends[d]) & (words[a] == words[np.minimum(a + p, s.n - 1)])
        behind = (a > starts[d]) & (words[np.maximum(a - 1, 0)] == words[a + p - 1])
        near = ahead | behind
        _extend(s, found, a[near], p[near], d[near], starts, ends, min_length, exponent)

    out = []
    for k, runs in enumerate(found):
        if runs:
            _copy(runs, cuts[k], starts[k], source, min_length)
        out.append(sorted((i, j - i, q) for (i, j), q in runs.items()))
    return out


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for every size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _extend(s: Suffixes, found: list, a: np.ndarray, p: np.ndarray, d: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int, exponent: int) -> None:
    """Runs of period p around the places a and a + p; the smallest period of a stretch stays."""
    lo, hi = a - s.behind(a, a + p), a + p + s.ahead(a, a + p)
    good = hi - lo >= np.maximum(min_length, exponent * p)
    for i, j, q, k in zip((lo - starts[d])[good].tolist(), (hi - starts[d])[good].tolist(), p[good].tolist(), d[good].tolist()):
        if q < found[k].get((i, j), q + 1):
            found[k][i, j] = q


def _copy(runs: dict, cuts: np.ndarray, lo: int, source: np.ndarray, least: int) -> None:
    """Adds the runs strictly inside each block, which its earlier copy has too; buckets hold runs by start."""
    bucket: dict[int, list[tuple[int, int]]] = {}
    for (i, j), q in runs.items():
        bucket.setdefault(i, []).append((j, q))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < least + 2 or source[a] < 0:
            continue
        a, b, shift = a - lo, b - lo, int(a - source[a])
        for i in range(a - shift + 1, b - shift - least):
            for j, q in bucket.get(i, ()):
                key = (i + shift, j + shift)
                if key[1] < b and key not in runs:
                    runs[key] = q
                    bucket.setdefault(key[0], []).append((key[1], q))


def _altered(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The words with a planted period, where the id's checksum asks for one."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return words[np.where(at < a, at, a + (at - a) % p)]


def detect(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, planted: bool = False) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed, runs``.

    The run with the greatest exact length over period is named (ties: smallest start, then period; without runs null).
    ``collapsed`` joins the words that no run contains behind its first period by one space; ``runs`` lists
    (start, length, period). Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Rows
    that repeat a doc_id are judged each by itself. ``planted`` alters the texts of a tenth of the ids first (a row without id stays).
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", "runs"]
    types = [*[pa.int64()] * 6, *[pa.string()] * 3, pa.list_(run)]

    def batch_of(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        every = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        codes, vocabulary = every.indices.to_numpy().astype(np.int64), every.dictionary.to_pylist()
        if planted:
            codes = np.concatenate([_altered(i, codes[e - len(t) : e]) for i, t, e in zip(ids, texts, ends.tolist())] or [codes])
        rows = []
        for i, e, t, runs in zip(ids, ends.tolist(), texts, enumerate_runs(codes, ends, min_length, exponent)):
            words = codes[e - len(t) : e]
            if runs:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, [s + q for s, _, q in runs], 1)
                np.add.at(gone, [s + n for s, n, _ in runs], -1)
                words = words[np.cumsum(gone)[:-1] == 0]
                best = runs[0]
                for r in runs[1:]:
                    if r[1] * best[2] > best[1] * r[2]:
                        best = r
            text = b" ".join([vocabulary[w] for w in words.tolist()])
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            top = (*best, 1000 * best[1] // best[2]) if runs else (None,) * 4
            rows.append((i, len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode(), [dict(zip(("start", "length", "period"), r)) for r in runs]))
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run_all(batches):
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = (t.as_py() or "").encode().split()
                if held and held + len(words) > CHUNK_WORDS:
                    yield batch_of(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(words)
                held += len(words)
        if ids:
            yield batch_of(ids, texts)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start:long,length:long,period:long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run_all, schema)
