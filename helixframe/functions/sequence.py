"""Sequence functions: complements, k-mers, similarities, alignment scores, repeats."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ascii_upper(s: Column) -> Column:
    return F.translate(s, "acgtn", "ACGTN")


def clean_bases(s: Column) -> Column:
    """Anything but A, C, G, T, N becomes N."""
    return F.regexp_replace(s, "[^ATCGN]", "N")


def revcomp(s: Column) -> Column:
    return F.reverse(F.translate(s, "ATCGN", "TAGCN"))


def with_revcomp(s: Column) -> Column:
    """A sequence, a separator, and its reverse complement."""
    return F.concat(s, F.lit("X"), revcomp(s))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: k-mers cut from one piece of a sequence, so that no substring walks a long sequence.
PIECE = 1024


def kmers(s: Column, k: int, step: int = 1) -> Column:
    """All k-mers at every ``step``; none for shorter sequences."""
    n, piece = F.length(s) - k + 1, max(1, PIECE // step) * step

    def cut(at: Column) -> Column:
        inside = F.sequence(F.lit(1), F.least(n - at, F.lit(piece)), F.lit(step))
        return _let(F.substring(s, at + 1, F.lit(piece + k - 1)), lambda t: F.transform(inside, lambda i: F.substring(t, i, F.lit(k))))

    starts = F.when(n >= 1, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(piece)))
    return F.coalesce(F.flatten(F.transform(starts, cut)), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 0 for two empty ones."""

    def ratio(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        return _let(F.struct(both.alias("both"), (F.size(p["a"]) + F.size(p["b"])).alias("sum")), lambda x: F.when(x["sum"] > 0, x["both"] / (x["sum"] - x["both"])).otherwise(0.0))

    return _let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), ratio)


def kmer_jaccard(a: Column, b: Column, k: int) -> Column:
    return jaccard(kmers(a, k), kmers(b, k))


def kmer_profile_similarity(df: DataFrame, id_col: str, a: str, b: str, k: int) -> DataFrame:
    """``id_col, similarity``: sum of the smaller relative frequency of every shared k-mer; 0 without any.

    Both sequences lie in one row, so their k-mers are counted there and none is shuffled.
    """

    def counts(s: str) -> Counter:
        return Counter([s[i : i + k] for i in range(len(s) - k + 1)])

    def similar(x: str | None, y: str | None) -> float:
        p, q = counts(x or ""), counts(y or "")
        if not p or not q:
            return 0.0
        n, m = len(x) - k + 1, len(y) - k + 1
        if len(q) < len(p):
            p, q, n, m = q, p, m, n
        return math.fsum(min(c / n, q[g] / m) for g, c in p.items() if g in q)

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(s, t) for s, t in zip(x, y)], dtype="float64")

    return df.select(id_col, F.pandas_udf(run, "double")(F.col(a), F.col(b)).alias("similarity"))


def dominant_kmer_ratio(s: Column, k: int = 17) -> Column:
    """Share of the most frequent of the non-overlapping k-mers."""

    def most(parts: Column) -> Column:
        # equal neighbours after sorting: the longest run, in one pass
        run = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("best"))

        def step(r, x):
            n = F.when(r["x"] == x, r["n"] + 1).otherwise(1)
            return F.struct(x.alias("x"), n.alias("n"), F.greatest(r["best"], n).alias("best"))

        return F.when(F.size(parts) > 0, F.aggregate(parts, run, step, lambda r: r["best"]) / F.size(parts)).otherwise(0.0)

    return _let(F.array_sort(kmers(s, k, k)), most)


def flank(s: Column, begin: Column, end: Column) -> Column:
    """Bounded substring [begin, end) of 0-based positions, clipped to the sequence."""
    b, e = F.greatest(begin, F.lit(0)), F.least(end, F.length(s))
    return F.when(e > b, F.substring(s, b + 1, e - b)).otherwise("")


def align_score(a: str, b: str, match: float = 1.0, mismatch: float = -1.0, gap: float = 1.5, free_ends: bool = False) -> float:
    """Score of the best global alignment with linear gaps; ``free_ends``: gaps around the shorter one are free.

    Row by row; the gaps along a row are a running maximum, so numpy does the inner loop.
    """
    if free_ends and len(a) > len(b):
        a, b = b, a
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    cost = gap * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1) if free_ends else -cost
    for i, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
        best = np.empty_like(row)
        best[0] = -gap * i
        best[1:] = np.maximum(row[:-1] + np.where(y == c, match, mismatch), row[1:] - gap)
        row = np.maximum.accumulate(best + cost) - cost
    return float(row.max() if free_ends else row[-1])


def affine_score(a: str, b: str, match: float = 1.0, mismatch: float = -1.0, opening: float = 2.0, extend: float = 0.5) -> float:
    """Global alignment score with affine gaps."""
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n = len(b)
    cost = extend * np.arange(n + 1)
    m = np.concatenate([[0.0], -(opening + extend * np.arange(n))]) if n else np.zeros(1)
    up = np.full(n + 1, -np.inf)
    for i, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
        up = np.maximum(up - extend, m - opening)
        base = up.copy()
        base[1:] = np.maximum(base[1:], m[:-1] + np.where(y == c, match, mismatch))
        side = np.full(n + 1, -np.inf)
        side[1:] = np.maximum.accumulate(base + cost)[:-1] - cost[:-1] - opening
        m = np.maximum(base, side)
    return float(m[-1])


#: Cells of the rows that a batch of alignments holds at a time.
CELLS = 1 << 18


def align_scores(a: list[str], b: list[str], match: float = 1.0, mismatch: float = -1.0, gap: float = 1.5, free_ends: bool = False) -> np.ndarray:
    """:func:`align_score` of many pairs at once: pairs of similar lengths share the rows of one table.

    Behind a pair's own end a row holds what cannot reach back, and a pair's score is read off when its last row is done.
    """
    if free_ends:
        a, b = zip(*[(y, x) if len(x) > len(y) else (x, y) for x, y in zip(a, b)]) if a else ((), ())
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.zeros(len(la))
    order = np.lexsort((la, lb))
    at = 0
    while at < len(order):
        width = 1
        stop = at
        while stop < len(order) and (stop == at or max(width, lb[order[stop]] + 1) * (stop + 1 - at) <= CELLS):
            width = max(width, int(lb[order[stop]]) + 1)
            stop += 1
        own = order[at:stop]
        own = own[np.argsort(-la[own], kind="stable")]  # the longest first, so that pairs that are done lie behind
        codes = lambda texts, size, fill: np.array([list(t) + [fill] * (size - len(t)) for t in (np.frombuffer(x.encode("utf-32-le"), np.uint32).tolist() for x in texts)], np.int64).reshape(len(texts), size)
        steps = int(la[own].max(initial=0))
        x, y = codes([a[k] for k in own], steps, -1), codes([b[k] for k in own], width - 1, -2)
        cost = gap * np.arange(width)
        row = np.zeros((len(own), width)) if free_ends else np.tile(-cost, (len(own), 1))
        inside = np.arange(width) <= lb[own][:, None]
        read = lambda done, rows: np.where(inside[done], rows, -np.inf).max(1) if free_ends else rows[np.arange(len(rows)), lb[own][done]]
        live = len(own)
        for i in range(steps + 1):
            if i:
                best = np.empty_like(row)
                best[:, 0] = -gap * i
                best[:, 1:] = np.maximum(row[:, :-1] + np.where(y[:live] == x[:live, i - 1 : i], match, mismatch), row[:, 1:] - gap)
                row = np.maximum.accumulate(best + cost, axis=1) - cost
            still = int(np.searchsorted(-la[own], -i, "left"))  # pairs with more rows than these
            if still < live:
                out[own[still:live]] = read(slice(still, live), row[still:])
                row, live = row[:still], still
        at = stop
    return out


def _scores(a: pd.Series, b: pd.Series, free_ends: bool) -> pd.Series:
    both = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[both] = align_scores(a[both].tolist(), b[both].tolist(), free_ends=free_ends)
    return pd.Series(out).where(both, None)


def _global(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scores(a, b, False)


def _free(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scores(a, b, True)


def alignment_score(a, b) -> Column:
    """Global alignment score of two columns; null for null."""
    return F.pandas_udf(_global, "double")(a, b)


def semiglobal_score(a, b) -> Column:
    """The same with free gaps around the shorter sequence."""
    return F.pandas_udf(_free, "double")(a, b)


def shift_search(df: DataFrame, id_col: str, left: str, right: str, span: str, ratios: int = 11, top: int = 5) -> DataFrame:
    """``id_col, shift``: best place of a breakpoint inside ``span`` bases.

    The flanks are scored at evenly spaced ratios; the ``top`` highest vote, the most
    frequent shift wins, the smaller on ties.
    """
    tried = df.select(id_col, left, right, span, F.explode(F.transform(F.sequence(F.lit(0), F.lit(ratios - 1)), lambda i: i / (ratios - 1))).alias("ratio"))
    tried = tried.withColumn("shift", (F.col("ratio") * F.col(span)).cast("bigint"))
    a, b = flank(F.col(left), F.col("shift").cast("int"), (F.col("shift") + F.col(span)).cast("int")), flank(F.col(right), F.col("shift").cast("int"), (F.col("shift") + F.col(span)).cast("int"))
    scored = tried.withColumn("score", alignment_score(a, b))
    from ..operators.dominance import top_k

    best = top_k(scored, [id_col], [F.desc("score"), F.asc("shift")], top)
    return best.groupBy(id_col, "shift").agg(F.count("*").alias("votes")).groupBy(id_col).agg(F.min_by("shift", F.struct(-F.col("votes"), "shift")).alias("shift"))


def shift_by_kmers(df: DataFrame, id_col: str, left: str, right: str, span: str, ratios: int = 19, sizes: tuple[int, ...] = tuple(range(5, 36, 2))) -> DataFrame:
    """``id_col, shift``: as :func:`shift_search`, but flanks are compared by their k-mers of several sizes.

    A row's flanks are compared where the row is: it leaves with the best shift of each size, and one shuffle by ``id_col`` brings
    rows of one identifier together.
    """
    sizes = tuple(dict.fromkeys(sizes))
    shifts = F.transform(F.sequence(F.lit(1), F.lit(ratios)), lambda i: ((i / (ratios + 1)) * F.col(span)).cast("bigint"))
    begins, ends = F.transform("_at", lambda x: x.cast("int")), F.transform("_at", lambda x: (x + F.col(span)).cast("int"))
    rows = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("_at", shifts).select(id_col, left, right, "_at", begins.alias("_b"), ends.alias("_e"))
    needed = lambda c: F.substring(c, F.lit(1), F.greatest(F.coalesce(F.array_max("_e"), F.length(c)), F.lit(0)))
    rows = rows.select(id_col, needed(left).alias("_l"), needed(right).alias("_r"), "_at", "_b", "_e")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda c, none: np.array([[none if x is None else x for x in v] for v in b.column(c).to_pylist()], np.int64)  # noqa: B023, E731
            best, at = _best_shifts(b.column(1).to_pylist(), b.column(2).to_pylist(), column(3, 0), column(4, 0), column(5, 1 << 40), sizes)
            chosen = pa.array([v[k] for v, ks in zip(b.column(3).to_pylist(), at.tolist()) for k in ks], pa.int64())
            none = pa.array((best < 0).ravel())
            votes = pa.StructArray.from_arrays([pa.array(best.ravel()), chosen], ["s", "shift"], mask=none)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(sizes)), votes)], [id_col, "votes"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("votes", T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("shift", T.LongType())])))])
    per = rows.mapInArrow(run, schema).repartition(id_col).select(id_col, F.posexplode("votes").alias("k", "v")).where("v is not null")
    votes = per.groupBy(id_col, "k").agg(F.min_by("v.shift", F.struct(-F.col("v.s"), "v.shift")).alias("shift"))
    return votes.groupBy(id_col, "shift").agg(F.count("*").alias("n")).groupBy(id_col).agg(F.min_by("shift", F.struct(-F.col("n"), "shift")).alias("shift"))


def _best_shifts(a: list[str], b: list[str], shifts: np.ndarray, begins: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of texts and size of k-mers the highest Jaccard of the texts' windows [begin, end) (below 0 where none holds a k-mer),
    and the number of its window, of equal ones that with the smallest shift. All windows of a part of the pairs are compared at once."""
    n, tries = shifts.shape
    best, at = np.full((n, len(sizes)), -1.0), np.zeros((n, len(sizes)), np.int64)
    widest = max([1, *map(len, a), *map(len, b)])
    step = max(1, CELLS // (tries * widest))
    for s in range(0, n, step):
        x, y = a[s : s + step], b[s : s + step]
        codes = np.frombuffer("".join([*x, *y]).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in [*x, *y]], np.int64)
        first = np.cumsum(size) - size
        own, place = slice(s, s + len(x)), np.arange(len(x))
        lo = np.maximum(begins[own], 0)
        spans = [(first[place + k][:, None] + lo, np.minimum(ends[own], size[place + k][:, None]) - lo) for k in (0, len(x))]
        names, length = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
        for j, k in sorted(enumerate(sizes), key=lambda z: z[1]):
            while length < k:  # a k-mer is two shorter ones that cover it
                ahead = min(length, k - length)
                names = np.unique(names * (len(codes) + 1) + np.append(names[ahead:], np.full(min(ahead, len(names)), len(codes))), return_inverse=True)[1].astype(np.int64)
                length += ahead
            some = np.flatnonzero(np.minimum(spans[0][1], spans[1][1]) >= k)
            if not len(some):
                break
            grams = []
            for begin, width in spans:
                many = width.ravel()[some][:, None] - k + 1
                i = np.arange(many.max())
                here = begin.ravel()[some][:, None] + i
                grams.append(np.where(i < many, names[np.minimum(here, len(names) - 1)], len(codes)).astype(np.int32))
            count = []
            for g in (*grams, np.concatenate(grams, axis=1)):
                g = np.sort(g, axis=1)
                count.append(1 + (g[:, 1:] != g[:, :-1]).sum(1) - (g[:, -1] == len(codes)))
            both = count[0] + count[1] - count[2]
            score = np.full(lo.shape, -1.0)
            score.ravel()[some] = both / (count[0] + count[1] - both)
            top = score.max(1)
            best[own, j] = top
            at[own, j] = np.where(score == top[:, None], shifts[own], np.iinfo(np.int64).max).argmin(1)
    return best, at


def cluster_similarity(members: DataFrame, keys: list[str], id_col: str, seq: str, k: int = 5, least_cv: float = 0.1, target: str | None = None) -> DataFrame:
    """``keys, similarity, n, cv``: k-mer profile similarities of the pairs of a cluster's sequences, summed, over the number of sequences.

    Where the lengths vary by more than ``least_cv``, only the length group whose mean is nearer to
    ``target`` (a column; the mean length if not given; ties: the shorter group) takes part. Clusters
    are of bounded size, as their depth is limited on admission.
    """
    from ..operators.aggregate import split_in_two

    length = F.length(seq)
    rows = members.select(*keys, id_col, F.col(seq).alias("_seq"), length.alias("_len"), (F.col(target) if target else F.lit(None)).cast("double").alias("_aim"))
    rows = split_in_two(rows, keys, "_len")
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("_len")))
    cv = F.coalesce(F.stddev_pop("_len") / F.avg("_len"), F.lit(0.0))
    aim = F.coalesce(F.max("_aim"), F.avg("_len"))
    nearer = F.abs(mean(1) - aim) < F.abs(mean(0) - aim)
    stat = rows.groupBy(*keys).agg(cv.alias("cv"), F.when(nearer, 1).otherwise(0).alias("_keep"))
    rows = rows.join(stat, keys).where((F.col("cv") <= least_cv) | (F.col("side") == F.col("_keep"))).select(*keys, "cv", id_col, "_seq", "_len")
    total = F.greatest(F.col("_len") - k + 1, F.lit(0))
    grams = rows.select(*keys, id_col, total.alias("_total"), F.explode(kmers(F.col("_seq"), k)).alias("_g")).groupBy(*keys, id_col, "_total", "_g").agg((F.count("*") / F.col("_total")).alias("_f"))
    side = lambda t: grams.select(*keys, "_g", F.col(id_col).alias(f"_i{t}"), F.col("_f").alias(f"_f{t}"))
    shared = side("a").join(side("b"), [*keys, "_g"]).where("_ia < _ib").groupBy(*keys).agg(F.sum(F.least("_fa", "_fb")).alias("_sum"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first("cv").alias("cv"))
    return size.join(shared, keys, "left").select(*keys, (F.coalesce("_sum", F.lit(0.0)) / F.col("n")).alias("similarity"), "n", "cv")


def max_subarray(values: Column) -> Column:
    """Largest sum of a contiguous non-empty part of an array of doubles (null for an empty one)."""
    first = F.element_at(values, 1).cast("double")
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    best = F.aggregate(
        rest, F.struct(first.alias("here"), first.alias("best")),
        lambda s, x: F.struct(F.greatest(s["here"] + x, x.cast("double")).alias("here"), F.greatest(s["best"], s["here"] + x, x.cast("double")).alias("best")), lambda s: s["best"],
    )
    return F.when(F.size(values) > 0, best)


def descending_above(values: Column, least: int) -> Column:
    """Distinct values above ``least``, falling."""
    return F.reverse(F.array_sort(F.array_distinct(F.filter(values, lambda x: x > least))))


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of an integer array, and the ranks of its suffixes by their first 1, 2, 4, ... codes.

    Prefix doubling: only suffixes whose rank another one shares are sorted again. The last ranks are all different.
    """
    n, h = len(codes), 1
    values, rank, size = np.unique(codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[rank]  # the number of suffixes before the class: others do not move when it splits
    levels = [rank.astype(np.int32)]
    live = np.flatnonzero(np.repeat(size, size)[rank] > 1) if n else np.empty(0, np.int64)
    while len(live):
        after = live + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, rank[live]))
        at, r, t = live[order], rank[live[order]], second[order]
        group = np.concatenate([[True], r[1:] != r[:-1]])
        new = group.copy()
        new[1:] |= t[1:] != t[:-1]
        place = np.arange(len(at))
        rank = rank.copy()
        rank[at] = r + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(rank.astype(np.int32))
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        live = np.sort(at[np.repeat(size, size) > 1])
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of pairs of different suffixes, by the ranks of the doubling: a step for each level, not for each base."""
    n = len(levels[0])
    x, y = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        same = (x < n) & (y < n)
        same &= rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]
        x, y = x + (same << k), y + (same << k)
    return x - a


_CODE = np.full(256, 4, np.uint64)
_CODE[[*b"ACGTacgt"]] = [0, 1, 2, 3] * 2
#: Bases that fit one key of :func:`repeated_places`.
_KEY = 32


def repeated_places(seq: str, size: int) -> np.ndarray:
    """Places of a sequence, its separator and its reverse complement at which bases begin that another place has too: ``size`` of them, or
    the first 32. No suffix is sorted.

    Keys of any length come from doubling and one overlapping step, two bits a base; a key with another letter counts for nothing.
    """
    k = max(1, min(size, _KEY))
    codes = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(codes)
    if n < k:
        return np.empty(0, np.int64)
    odd = codes == 4

    def keys(x: np.ndarray) -> np.ndarray:
        key, h = x, 1
        while 2 * h <= k:
            key, h = (key[: len(key) - h] << np.uint64(2 * h)) | key[h:], 2 * h
        if h < k:  # the last h bases overlap those before
            key = (key[: len(key) - (k - h)] << np.uint64(2 * (k - h))) | (key[k - h :] & np.uint64((1 << 2 * (k - h)) - 1))
        return key

    codes[odd] = 0
    every, place = [keys(codes), keys(np.uint64(3) - codes[::-1])], [np.arange(n - k + 1), np.arange(n + 1, 2 * n - k + 2)]
    if odd.any():
        seen = np.concatenate([[0], np.cumsum(odd)])
        clean = seen[k:] == seen[:-k]
        every, place = [every[0][clean], every[1][clean[::-1]]], [place[0][clean], place[1][clean[::-1]]]
    both = np.concatenate(every)
    ranked = np.sort(both)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.empty(0, np.int64)
    return np.concatenate(place)[np.isin(both, twice)]


#: Places that are sorted by their own next codes, and how many of these, before all suffixes are.
_PLACES, _AHEAD = 512, 512


def _neighbours(codes: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Neighbours in suffix order among the places ``live``, and their common lengths; nothing where the next codes do not decide."""
    if len(live) > _PLACES or len(codes) >= 1 << 24:
        return None
    data = codes.astype(">u4").tobytes()
    ahead = {i: data[4 * i : 4 * (i + _AHEAD)] for i in live.tolist()}
    order = sorted(ahead, key=ahead.__getitem__)
    size = []
    for i, j in zip(order, order[1:]):
        m = min(len(ahead[i]), len(ahead[j])) // 4
        differ = codes[i : i + m] != codes[j : j + m]
        at = int(differ.argmax()) if m else 0
        if m == _AHEAD and not differ[at]:
            return None
        size.append(at if m and differ[at] else m)
    at = np.array(order, np.int64)
    return at[:-1], at[1:], np.array(size, np.int64)


def repeats_in(seq: str, min_size: int, min_dist: int) -> list[tuple[str, int, int, int]]:
    """(kind, start1, start2, length) of repeats between suffix-array neighbours of a sequence with its reverse complement.

    'dup': both on the forward strand and at least ``min_dist`` apart; 'inv': one on each
    strand, positions on the forward strand. Separators and N never match.
    """
    seq = re.sub("[^ACGT]", "N", seq.upper())
    n = len(seq)
    live = repeated_places(seq, max(1, min_size))
    if not len(live):  # most sequences, where the repeats are long
        return []
    both = seq + "X" + seq[::-1].translate(str.maketrans("ATCG", "TAGC"))
    codes = np.frombuffer(both.encode(), np.uint8).astype(np.int64)
    odd = (codes == ord("N")) | (codes == ord("X"))
    codes[odd] = 1000 + np.arange(int(odd.sum()))
    # places with equal first bases are together in the order of all suffixes, so these alone are enough
    near = _neighbours(codes, live)
    if near is None:
        sa, levels = suffix_ranks(codes)
        near = sa[:-1], sa[1:], common_prefixes(levels, sa[:-1], sa[1:])
    i, j, size = np.minimum(near[0], near[1]), np.maximum(near[0], near[1]), near[2]
    long = size >= max(1, min_size)
    dup, inv = long & (j < n) & (j - i >= min_dist), long & (i < n) & (j > n)
    p = 2 * n + 1 - j - size
    found = [("dup", *r) for r in zip(i[dup].tolist(), j[dup].tolist(), size[dup].tolist())]
    found += [("inv", *r) for r in zip(np.minimum(i, p)[inv].tolist(), np.maximum(i, p)[inv].tolist(), size[inv].tolist())]
    return sorted(set(found))


def repeat_scan(seqs: DataFrame, contig: str, seq: str, window: int = 100_000, step: int = 50_000, min_size: int = 1, min_dist: int = 5) -> DataFrame:
    """Repeats of every sliding window: ``contig, kind, pos1, pos2, size`` in contig coordinates, distinct."""
    # blocks of many windows first, so that no substring walks a long sequence for each window; only blocks are shuffled
    block = 64 * step
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(block))).alias("base")
    rows = seqs.where(F.col(seq).isNotNull()).select(F.col(contig).cast("string").alias("contig"), F.col(seq).alias("_s"), starts)
    rows = rows.select("contig", "base", F.substring("_s", F.col("base") + 1, F.lit(block + window - 1)).alias("_s"))
    rows = rows.repartition("contig", "base")
    inside = F.explode(F.sequence(F.lit(0), F.greatest(F.least(F.length("_s"), F.lit(block)) - 1, F.lit(0)), F.lit(step))).alias("at")
    cut = rows.select("contig", "base", "_s", inside).select("contig", (F.col("base") + F.col("at")).alias("at"), F.substring("_s", F.col("at") + 1, F.lit(window)).alias("win"))

    return repeats_of(cut, min_size, min_dist).distinct()


def repeats_of(rows: DataFrame, min_size: int, min_dist: int) -> DataFrame:
    """``contig, kind, pos1, pos2, size`` of the repeats within each row of ``contig, at, seq``, of which ``at`` is the position."""

    def run(batches):
        for b in batches:
            for c, a, w in zip(*(b.column(k).to_pylist() for k in range(3))):
                r = repeats_in(w, min_size, min_dist)
                if r:
                    yield pa.RecordBatch.from_pydict({"contig": [c] * len(r), "kind": [x[0] for x in r], "pos1": [a + x[1] for x in r], "pos2": [a + x[2] for x in r], "size": [x[3] for x in r]})

    return rows.mapInArrow(run, "contig string, kind string, pos1 bigint, pos2 bigint, size bigint")


def merged_repeats(repeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged direct repeats (``pos1, pos2 + size, size``) and inverted ones (also arm bounds and centre)."""
    from ..operators.dominance import greedy_chain

    rows = repeats.select("contig", "kind", "pos1", (F.col("pos2") + F.col("size")).alias("pos2"), F.col("pos2").alias("r2"), "size")
    dup = greedy_chain(rows.where("kind = 'dup'"), ["contig"], "pos1", "pos2", "size").select("contig", "pos1", "pos2", "size")
    inv = greedy_chain(rows.where("kind = 'inv'"), ["contig"], "pos1", "pos2", "size", 50)
    return dup, inv.select("contig", "pos1", "pos2", (F.col("pos1") + F.col("size")).alias("r1"), "r2", "size", ((F.col("pos1") + F.col("pos2")) / 2).cast("bigint").alias("center"))
