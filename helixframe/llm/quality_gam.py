"""Quality classifier: a generalised additive model with pairwise interactions.

Training boosts shallow trees on one feature at a time, in cycles, and adds each
tree into that feature's lookup table; then the strongest pairs of features get
tables of their own from what is left. A score is an intercept plus one table cell
for each feature and pair, found by vectorised binning. Features describe the whole
text only: labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bound: the model is fitted on at most this many labelled rows, chosen by hash.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 40, 0.15

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "capitals", "digits", "stops", "symbols", "newlines", "pipes", "marks", "non_ascii",
    "repeated_next", "distinct_lines", "line_length", "short_lines", "longest_word", "entropy", "top_word", "common_words", "distinct_pairs", "stop_words",
)
#: Frequent function words of the corpus's languages.
COMMON = frozenset(
    "the of and a in to is that it for on was with be as by this are at from or an "
    "der die das und in von zu den mit sich auf für ist im dem ein eine als des "
    "de la le et les des du un une en est que pour dans qui au par el los y se las del por con su".split()
)
_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_STOP = [ord(c) for c in ".,;:"]
_SYMBOL = [ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]


def features(text: str | None) -> list[float]:
    """The feature vector of a whole text; finite for null and empty texts too."""
    text = text or ""
    data = text.encode()
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    nw = max(1, len(words))
    lines = text.split("\n")
    used = counts[counts > 0] / n
    upper, lower = float(counts[_UPPER].sum()), float(counts[_LOWER].sum())
    tally = Counter(words)
    chars = len(text)
    lens = list(map(len, lines))
    return [
        math.log1p(chars),
        math.log1p(len(words)),
        min(40.0, sum(map(len, words)) / nw),
        len(tally) / nw,
        upper / max(1.0, upper + lower),
        float(counts[_DIGIT].sum()) / n,
        float(counts[_STOP].sum()) / nw,
        float(counts[_SYMBOL].sum()) / n,
        float(counts[10]) / nw,
        float(counts[124]) / nw,
        float(counts[33]) / nw,
        float(counts[128:].sum()) / n,
        sum(map(eq, words, words[1:])) / nw,
        len(set(lines)) / len(lines),
        math.log1p(chars / len(lines)),
        sum(1 for x in lens if x < 25) / len(lens),
        math.log1p(max(map(len, words), default=0)),
        float(-(used * np.log2(used)).sum()) if len(data) else 0.0,
        max(tally.values(), default=0) / nw,
        sum(tally[w] for w in COMMON if w in tally) / nw,
        len(set(zip(words, words[1:]))) / nw,
        float(sum(tally[w] for w in tally.keys() & COMMON_STOPPED)) / nw,
    ]


COMMON_STOPPED = frozenset(w + s for w in COMMON for s in (".", ","))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value for each bin of the best tree of two levels on one binned feature."""

    def split(lo: int, hi: int) -> list[tuple[int, int]]:
        if hi - lo < 2:
            return [(lo, hi)]
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        tg, th = g[lo:hi].sum(), h[lo:hi].sum()
        score = _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th)
        k = int(score.argmax())
        return [(lo, lo + k + 1), (lo + k + 1, hi)] if score[k] > 1e-6 else [(lo, hi)]

    out = np.zeros(len(g))
    for lo, hi in split(0, len(g)):
        for a, b in split(lo, hi):
            out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _crossed(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best tree of two levels on a pair: a cut of the first feature, then one of the second on each side."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, where = 0.0, None
    sides = []
    for top in (True, False):
        a_g, a_h = (cg[:-1], ch[:-1]) if top else (cg[-1] - cg[:-1], ch[-1] - ch[:-1])
        tg, th = a_g[:, -1:], a_h[:, -1:]
        s = _gain(a_g[:, :-1], a_h[:, :-1]) + _gain(tg - a_g[:, :-1], th - a_h[:, :-1])
        sides.append((s.max(1), s.argmax(1)))
    total = sides[0][0] + sides[1][0] - _gain(cg[-1, -1], ch[-1, -1])
    k = int(total.argmax())
    best = float(total[k])
    out = np.zeros_like(g)
    for rows, (_, cut) in zip((slice(0, k + 1), slice(k + 1, None)), sides):
        c = int(cut[k]) + 1
        for cols in (slice(0, c), slice(c, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return out, best


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _bin(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Lookup tables from features and 0/1 labels. Without rows of both labels the model is a constant."""
    if len(y) == 0 or y.min() == y.max():
        prior = 1.0 if len(y) == 0 else float(y[0])
        return {"intercept": 20.0 * (2 * prior - 1), "edges": [], "tables": [], "pairs": []}
    n, k = x.shape
    edges = [_edges(x[:, j], BINS) for j in range(k)]
    bins = [_bin(x[:, j], e) for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    p = y.mean()
    intercept = math.log(p / (1 - p))
    f = np.full(n, intercept)
    for _ in range(ROUNDS):
        for j in range(k):
            q = 1 / (1 + np.exp(-f))
            size = len(tables[j])
            step = RATE * _shallow(np.bincount(bins[j], y - q, size), np.bincount(bins[j], q * (1 - q), size))
            tables[j] += step
            f += step[bins[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    cbins = [_bin(x[:, j], e) for j, e in enumerate(coarse)]

    def hist(a: int, b: int, v: np.ndarray) -> np.ndarray:
        m = len(coarse[b]) + 1
        return np.bincount(cbins[a] * m + cbins[b], v, (len(coarse[a]) + 1) * m).reshape(-1, m)

    q = 1 / (1 + np.exp(-f))
    wide = [j for j in range(k) if len(coarse[j])]
    ranked = sorted(((_crossed(hist(a, b, y - q), hist(a, b, q * (1 - q)))[1], a, b) for i, a in enumerate(wide) for b in wide[i + 1 :]), reverse=True)
    pairs = [[a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))] for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, _, _, t in pairs:
            q = 1 / (1 + np.exp(-f))
            step = RATE * _crossed(hist(a, b, y - q), hist(a, b, q * (1 - q)))[0]
            t += step
            f += step[cbins[a], cbins[b]]
    return {"intercept": intercept, "edges": edges, "tables": tables, "pairs": pairs}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: table lookups and additions only."""
    f = np.full(len(x), model["intercept"])
    for j, (e, t) in enumerate(zip(model["edges"], model["tables"])):
        f += t[_bin(x[:, j], e)]
    for a, b, ea, eb, t in model["pairs"]:
        f += t[_bin(x[:, a], ea), _bin(x[:, b], eb)]
    return 1 / (1 + np.exp(-f))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``rows`` labelled documents that are not held out (a bounded sample).

    Chosen by the hash of doc_id; null labels are no labels, the larger of two counts.
    Only the sample's feature vectors come to the driver.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches):
        for b in batches:
            x = [np.asarray(features(t), "<f8").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    got = picked.mapInArrow(run, "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), "<f8").reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def _scored(batch, at: int, model: dict) -> np.ndarray:
    return score(model, np.array([features(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES)))


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    Null and empty texts have a score too; without doc_id ``held_out`` is null. Other columns are not read.
    """

    def run(batches):
        for b in batches:
            s = _scored(b, 2, model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns, whatever their names."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scored(b, at, model) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
