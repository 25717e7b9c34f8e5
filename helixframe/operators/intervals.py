"""Interval relations as equi joins.

Every interval [b, e) enters the bins of its own length level, and those of the coarser
levels that the other side uses; a pair meets on the coarser level of the two, where at
least one of them is at home, and is kept in exactly one bin. An interval of any length has a
bounded number of rows, short intervals never meet in coarse bins, and no inequality join is
left. Which levels a side uses is known where its intervals have one length, and else counts as
all, or is measured by a scalar subquery of the same plan (one number; for plans that are
cheap to compute twice).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIN, FACTOR, LEVELS = 64, 16, 6


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """``names``, lengthened until they clash with no column (Spark's names ignore case)."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def _floor_div(x: Column, size) -> Column:
    return ((x - F.pmod(x, size)) / size).cast("bigint")


def _size(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(BIN * FACTOR**k).cast("bigint") for k in range(LEVELS)]), level + 1)


def _level(b: Column, e: Column) -> Column:
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(e - b <= BIN * FACTOR**k, k).otherwise(level)
    return level


def _used(df: DataFrame, begin: str, end: str, length: int | None, measure: bool) -> Column:
    """Bits of the levels that a side's intervals have."""
    if length is not None:
        return F.lit(1 << next(k for k in range(LEVELS) if k == LEVELS - 1 or length <= BIN * FACTOR**k))
    if not measure:
        return F.lit((1 << LEVELS) - 1)
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(LEVELS)]), _level(*_bounds(begin, end)) + 1)
    return F.coalesce(df.select(F.bit_or(bit).alias("_used")).scalar(), F.lit(0))


def _bounds(begin: str, end: str) -> tuple[Column, Column]:
    b = F.col(begin).cast("bigint")
    return b, F.greatest(F.col(end).cast("bigint"), b + 1)


def _binned(df: DataFrame, begin: str, end: str, names: tuple[str, str, str, str], used: Column, kinds: tuple[int, int]) -> DataFrame:
    """Rows exploded to bins, with the columns level, bin, first bin and kind of meeting under ``names``.
    ``used``: levels of the other side; ``kinds``: the kind of meeting with shorter intervals of the other side on the own level, and with longer ones on theirs."""
    level, bin_, first, meet = names
    bits, flags, x = fresh_names([*df.columns, *names], "used", "has", "x")
    b, e = _bounds(begin, end)
    own = _level(b, e)
    has = lambda lv: F.get(F.col(flags), lv)
    shorter = F.exists(F.sequence(F.lit(0), own), lambda lv: (lv < own) & has(lv))
    at_home = F.filter(F.array(F.when(has(own), 0), F.when(shorter, kinds[0])), lambda k: k.isNotNull())
    meets = lambda lv: F.when(lv == own, at_home).otherwise(F.when(has(lv), F.array(F.lit(kinds[1]))).otherwise(F.array().cast("array<int>")))
    bins = lambda lv: F.sequence(_floor_div(b, _size(lv)), _floor_div(e - 1, _size(lv)))
    at = lambda lv: F.flatten(F.transform(meets(lv), lambda k: F.transform(bins(lv), lambda y: F.struct(lv.alias("level"), y.alias("bin"), _floor_div(b, _size(lv)).alias("first"), k.alias("kind")))))
    rows = df.withColumn(bits, used).withColumn(flags, F.array(*[F.col(bits).bitwiseAND(F.lit(1 << k)) != 0 for k in range(LEVELS)]))
    rows = rows.withColumn(x, F.explode(F.flatten(F.transform(F.sequence(own, F.lit(LEVELS - 1)), at))))
    return rows.select(*df.columns, F.col(f"{x}.level").alias(level), F.col(f"{x}.bin").alias(bin_), F.col(f"{x}.first").alias(first), F.col(f"{x}.kind").alias(meet))


def _sides(left: DataFrame, right: DataFrame, lb: str, le: str, rb: str, re: str, lengths: tuple[int | None, int | None], measure: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in bins, the right one's level, bin and kind under names of their own; and the seven names."""
    names = fresh_names([*left.columns, *right.columns], "level", "bin", "meet", "firstl", "firstr", "level_r", "bin_r", "meet_r")
    level, bin_, meet, first_l, first_r, level_r, bin_r, meet_r = names
    # kinds of meeting: 0 both on their own level, 1 only the left one, 2 only the right one
    a = _binned(left, lb, le, (level, bin_, first_l, meet), _used(right, rb, re, lengths[1], measure), (1, 2))
    b = _binned(right, rb, re, (level_r, bin_r, first_r, meet_r), _used(left, lb, le, lengths[0], measure), (2, 1))
    return a, b, names


def _overlap(lb: str, le: str, rb: str, re: str) -> Column:
    le_, re_ = F.greatest(F.col(le), F.col(lb) + 1), F.greatest(F.col(re), F.col(rb) + 1)
    return (F.col(lb) < re_) & (F.col(rb) < le_)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lb: str, le: str, rb: str, re: str, lengths: tuple[int | None, int | None] = (None, None), measure: bool = False) -> DataFrame:
    """Inner join of overlapping half-open intervals with equal ``keys``; other columns must differ in name.

    An empty interval counts as one position. Rows with a null key or bound do not join. ``lengths``: the
    one length of all intervals of a side, if it is known; ``measure``: look up the used levels of the others.
    """
    a, b, names = _sides(left, right, lb, le, rb, re, lengths, measure)
    level, bin_, meet, first_l, first_r, level_r, bin_r, meet_r = names
    both = a.join(b.withColumnsRenamed({level_r: level, bin_r: bin_, meet_r: meet}), [*keys, level, bin_, meet])
    once = F.col(bin_) == F.greatest(first_l, first_r)
    return both.where(_overlap(lb, le, rb, re) & once).drop(*names)


#: Positions in a bin of the sweeps, and the lengths up to which intervals lie in bins of a level.
SWEEP = 1 << 16
DEPTH_SIZES = (1 << 16, 1 << 22, 1 << 40)
#: Rows that a task counts at a time.
DEPTH_CHUNK = 1 << 18


def overlap_counts(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, lb: str, le: str, rb: str, re: str) -> DataFrame:
    """``left_id, n``: how many intervals of ``right`` with equal ``keys`` overlap each of ``left`` (0 where none does).

    An overlapping interval begins before the end and does not end before the begin, so n is a difference of two
    counts along the key: running sums over sorted bounds, within bins that begin with the sums before them. No
    pair is formed, and bounds that are equal are added up before they meet. An empty interval counts as one position; rows with a
    null key or bound overlap nothing; ``left_id`` is unique.
    """
    names = fresh_names([*keys, left_id], "p", "kind", "nb", "ne", "bin", "id")
    p, kind, nb, ne, bin_, id_ = names
    known = lambda b, e: reduce(and_, [F.col(c).isNotNull() for c in (*keys, b, e)])
    long = lambda x: F.lit(x).cast("bigint")
    (b, e), (rb_, re_) = _bounds(lb, le), _bounds(rb, re)
    ends = F.explode(F.array(F.struct(rb_.alias(p), long(1).alias(nb), long(0).alias(ne)), F.struct(re_.alias(p), long(0).alias(nb), long(1).alias(ne)))).alias(kind)
    bounds = right.where(known(rb, re)).select(*keys, ends).select(*keys, f"{kind}.*").groupBy(*keys, p).agg(F.sum(nb).alias(nb), F.sum(ne).alias(ne))
    asks = F.explode(F.array(F.struct(e.alias(p), F.lit(0).alias(kind)), F.struct(b.alias(p), F.lit(2).alias(kind)))).alias(nb)
    asked = left.where(known(lb, le)).select(*keys, F.col(left_id).alias(id_), asks).select(*keys, id_, f"{nb}.*")
    at = _floor_div(F.col(p), long(SWEEP)).alias(bin_)
    none = F.lit(None).cast(left.schema[left_id].dataType)
    events = bounds.select(*keys, at, p, F.lit(1).alias(kind), nb, ne, none.alias(id_)).unionByName(asked.select(*keys, at, p, kind, long(0).alias(nb), long(0).alias(ne), id_))
    before = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy(*keys, bin_).agg(F.sum(nb).alias(nb), F.sum(ne).alias(ne))
    carry = sums.select(*keys, bin_, (F.col(bin_) * SWEEP - 1).alias(p), F.lit(1).alias(kind), F.coalesce(F.sum(nb).over(before), long(0)).alias(nb), F.coalesce(F.sum(ne).over(before), long(0)).alias(ne), none.alias(id_))
    upto = Window.partitionBy(*keys, bin_).orderBy(p, kind).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = events.unionByName(carry).select(kind, id_, F.sum(nb).over(upto).alias(nb), F.sum(ne).over(upto).alias(ne)).where(F.col(kind) != 1)
    n = F.sum(F.when(F.col(kind) == 0, F.col(nb)).otherwise(-F.col(ne)))
    counted = run.groupBy(F.col(id_).alias(left_id)).agg(n.alias("n"))
    return counted.union(left.where(~known(lb, le)).select(left_id, long(0)))


def matched_ids(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, lb: str, le: str, rb: str, re: str, where: Column | None = None, measure: bool = False, lengths: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Distinct ``left_id`` of rows with a partner, that also satisfies ``where`` if it is given. ``left_id`` is unique.

    A semi join within the bins stops at a row's first partner, so no pairs are written. ``where`` names no key.
    """
    if where is None:
        return overlap_counts(left, right, keys, left_id, lb, le, rb, re).where("n > 0").select(left_id)
    a, b, names = _sides(left, right, lb, le, rb, re, lengths, measure)
    others = fresh_names([*a.columns, *b.columns], *keys)
    b = b.withColumnsRenamed(dict(zip(keys, others)))
    same = [F.col(x) == F.col(y) for x, y in [*zip(keys, others), *zip(names[:3], names[5:])]]
    return a.join(b, reduce(and_, same) & _overlap(lb, le, rb, re) & where, "left_semi").select(left_id).distinct()


def semi_overlap(left: DataFrame, right: DataFrame, keys, left_id, lb, le, rb, re, where=None, measure=False) -> DataFrame:
    return left.join(matched_ids(left, right, keys, left_id, lb, le, rb, re, where, measure), left_id, "left_semi")


def anti_overlap(left: DataFrame, right: DataFrame, keys, left_id, lb, le, rb, re, where=None, measure=False) -> DataFrame:
    return left.join(matched_ids(left, right, keys, left_id, lb, le, rb, re, where, measure), left_id, "left_anti")


def _banded(left: DataFrame, right: DataFrame, lpos: str, rpos: str, width: int) -> tuple[DataFrame, DataFrame, list[str]]:
    names = fresh_names([*left.columns, *right.columns], "b", "e", "p", "q")
    lo, hi, at, end = names
    a = left.withColumn(lo, F.col(lpos) - width).withColumn(hi, F.col(lpos) + width + 1)
    return a, right.withColumn(at, F.col(rpos)).withColumn(end, F.col(rpos) + 1), names


def band_join(left: DataFrame, right: DataFrame, keys: list[str], lpos: str, rpos: str, width: int) -> DataFrame:
    """Pairs of points with equal keys at most ``width`` apart."""
    a, b, names = _banded(left, right, lpos, rpos, width)
    return overlap_join(a, b, keys, *names, (2 * width + 1, 1)).drop(*names)


def near_ids(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, lpos: str, rpos: str, width: int, where: Column) -> DataFrame:
    """Distinct ``left_id`` of points with a partner at most ``width`` away that satisfies ``where``; no pairs are written. ``where`` names no key.

    All points of a side have one length, so there is one level: a point of ``right`` is in its bin, one of ``left`` in those that it reaches.
    """
    bin_, bin_r = fresh_names([*left.columns, *right.columns], "bin", "bin_r")
    others = fresh_names([*left.columns, *right.columns, bin_, bin_r], *keys)
    size, at, other = F.lit(max(BIN, 2 * width + 1)).cast("bigint"), F.col(lpos).cast("bigint"), F.col(rpos).cast("bigint")
    a = left.withColumn(bin_, F.explode(F.sequence(_floor_div(at - width, size), _floor_div(at + width, size))))
    b = right.withColumn(bin_r, _floor_div(other, size)).withColumnsRenamed(dict(zip(keys, others)))
    same = [F.col(x) == F.col(y) for x, y in [*zip(keys, others), (bin_, bin_r)]]
    return a.join(b, reduce(and_, same) & (F.abs(F.col(lpos) - F.col(rpos)) <= width) & where, "left_semi").select(left_id).distinct()


def _before_and_at_most(begins: np.ndarray, ends: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For every (p, q) the number of intervals with begin <= p and end <= q; ``begins`` ascends.

    A wavelet matrix over the ranks of the ends, for all questions at once.
    """
    n = len(begins)
    order = np.argsort(ends, kind="stable")
    value = np.empty(n, np.int64)
    value[order] = np.arange(n)
    limit = np.searchsorted(ends[order], q, "right")
    lo, hi, out = np.zeros(len(p), np.int64), np.searchsorted(begins, p, "right"), np.zeros(len(p), np.int64)
    for k in range(n.bit_length() - 1, -1, -1):
        one = (value >> k) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        below = limit >> k & 1 == 1
        zl, zh = zeros[lo], zeros[hi]
        out += np.where(below, zh - zl, 0)
        lo, hi = np.where(below, zeros[-1] + lo - zl, zl), np.where(below, zeros[-1] + hi - zh, zh)
        value = np.concatenate([value[~one], value[one]])
    return out


def stab_depth(clusters: DataFrame, alignments: DataFrame, keys: list[str], id_col: str, start: str, stop: str, a_id: str, ab: str, ae: str, pad: int = 100, fallback: str | None = None) -> DataFrame:
    """``id_col, depth``: alignments that cover ``start - pad`` or ``stop + pad`` (each counts once).

    With ``fallback`` a depth of zero becomes that column. ``id_col`` is unique; rows of one ``a_id`` are one alignment. A
    null key, position or bound meets nothing.

    Counted, not joined: what covers the first place, and the second, less what covers both. An alignment is in at most two bins of
    its length's level; a cluster asks in the bins of its places, and counts of all levels add up. Of a bin
    only the questions are held, alignments stream through in chunks.
    """
    g = fresh_names([*keys, id_col], "level", "bin", "kind", "x", "y", "h", "id", "fb")
    level, bin_, kind, x, y, h, id_, fb = g
    long = lambda v: v.cast("bigint")
    known = lambda *cs: reduce(and_, [F.col(c).isNotNull() for c in cs])
    size = lambda lv: F.element_at(F.array(*[long(F.lit(n)) for n in DEPTH_SIZES]), lv + 1)
    spare = long(F.col(fallback)) if fallback else long(F.lit(0))
    one, two = long(F.col(start) - pad), long(F.col(stop) + pad)
    ask = F.explode(F.flatten(F.array(*[
        F.array(*[F.struct(F.lit(lv).alias(level), _floor_div(at, long(F.lit(n))).alias(bin_), F.lit(role).cast("bigint").alias(h)) for role, at in ((0, one), (1, two))]) for lv, n in enumerate(DEPTH_SIZES)
    ]))).alias(kind)
    asked = clusters.where(known(*keys, start, stop)).select(*keys, ask, one.alias(x), two.alias(y), F.col(id_col).alias(id_), spare.alias(fb))
    asked = asked.select(*keys, f"{kind}.{level}", f"{kind}.{bin_}", F.lit(0).alias(kind), x, y, f"{kind}.{h}", id_, fb)
    b, e = long(F.col(ab)), F.greatest(long(F.col(ae)), long(F.col(ab)) + 1)
    own = F.when(e - b <= DEPTH_SIZES[0], 0).when(e - b <= DEPTH_SIZES[1], 1).otherwise(2)
    covers = alignments.where(known(*keys, ab, ae)).select(*keys, own.alias(level), F.lit(1).alias(kind), b.alias(x), e.alias(y), F.xxhash64(a_id).alias(h))
    places = F.explode(F.sequence(_floor_div(F.col(x), size(F.col(level))), _floor_div(F.col(y) - 1, size(F.col(level))))).alias(bin_)
    covers = covers.select(*keys, level, places, kind, x, y, h, F.lit(None).cast(clusters.schema[id_col].dataType).alias(id_), F.lit(None).cast("bigint").alias(fb))
    by = [*keys, level, bin_]
    work = asked.unionByName(covers).repartition(*by).sortWithinPartitions(*by, kind, x, y, h)

    def counted(t: pa.Table, group: np.ndarray, last: list) -> pa.RecordBatch:
        """Counts of the questions of ``t``; ``group`` numbers its bins. A row that repeats the one before is dropped."""
        k, a, z, i = (t.column(c).to_numpy() for c in (kind, x, y, h))
        place = lambda v: group * np.int64(1 << 40) + np.clip(v, -(1 << 38), 1 << 39) + (1 << 38)
        rows = k == 1
        same = np.zeros(len(k), bool)
        same[1:] = rows[1:] & rows[:-1] & (group[1:] == group[:-1]) & (a[1:] == a[:-1]) & (z[1:] == z[:-1]) & (i[1:] == i[:-1])
        if len(k) and last and rows.any():
            f = int(np.argmax(rows))
            same[f] |= last[0] == (int(a[f]), int(z[f]), int(i[f])) and group[f] == 0
        rows &= ~same
        begin, end = place(a)[rows], place(z)[rows]
        q = np.flatnonzero(k == 0)
        p1, p2, role = place(a)[q], place(z)[q], i[q]
        at = np.where(role == 0, p1, p2)
        order = np.sort(end)
        n = np.searchsorted(begin, at, "right") - np.searchsorted(order, at, "right")
        first = role == 0
        if len(begin) and first.any():  # less those that cover both places: begin <= p1 and end > p2
            n[first] -= np.searchsorted(begin, p1[first], "right") - _before_and_at_most(begin, end, p1[first], p2[first])
        take = pa.array(q)
        return pa.RecordBatch.from_arrays([t.column(id_).combine_chunks().take(take), pa.array(n), t.column(fb).combine_chunks().take(take)], [id_, "n", fb])

    def run(batches):
        held: list[pa.Table] = []
        rows, last = 0, []
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                rows += b.num_rows
            if rows >= DEPTH_CHUNK:
                held, rows, last = yield from flush(held, last)
        if held:
            yield from flush(held, last)

    def flush(held, last):
        t = pa.concat_tables(held).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        for c in by:
            v = t.column(c).combine_chunks()
            new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        group = np.cumsum(new)
        yield counted(t, group, last)
        # the questions of the bin that is still open stay, and its last row, of which copies may follow
        open_ = (group == group[-1]) & (t.column(kind).to_numpy() == 0)
        end = t.slice(t.num_rows - 1, 1)
        last = [tuple(end.column(c)[0].as_py() for c in (x, y, h))] if end.column(kind)[0].as_py() == 1 else []
        kept = t.filter(pa.array(open_))
        if not kept.num_rows:  # a bin without questions: its key has to be known all the same
            kept = end.set_column(end.column_names.index(kind), kind, pa.array([2], end.schema.field(kind).type))
        return [kept], 0, last

    schema = T.StructType([T.StructField(id_, clusters.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField(fb, T.LongType())])
    found = work.mapInArrow(run, schema).groupBy(F.col(id_).alias(id_col)).agg(F.sum("n").alias("n"), F.max(fb).alias(fb))
    depth = F.when(F.col("n") == 0, F.coalesce(F.col(fb), F.lit(0))).otherwise(F.col("n")).cast("bigint")
    rest = clusters.where(~known(*keys, start, stop)).select(id_col, F.coalesce(spare, F.lit(0)).cast("bigint").alias("depth"))
    return found.select(id_col, depth.alias("depth")).union(rest)


def merge_intervals(df: DataFrame, keys: list[str], begin: str, end: str, gap: int = 0) -> DataFrame:
    """Maximal chains of intervals at most ``gap`` apart: ``keys, begin, end, n``."""
    from .cluster import regions

    rows, region = regions(df.select(*keys, begin, end), keys, F.col(begin), F.col(end), gap + 1)
    new, chain = fresh_names(rows.columns, "new", "chain")
    w = Window.partitionBy(*keys, region).orderBy(begin, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn(new, F.when(F.col(begin) <= far + gap, 0).otherwise(1))
    grouped = marked.withColumn(chain, F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, region, chain).agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n")).drop(region, chain)


def fallback_lookup(sites: DataFrame, clusters: DataFrame, ends: DataFrame, keys: list[str], id_col: str, pos: str, cpos: str, epos: str, width: int) -> DataFrame:
    """Partners of each site: clusters near it, or, only where there is none, raw alignment ends near it.

    ``id_col, partner, source`` with source 'cluster' or 'ends'.
    """
    s = sites.select(*keys, F.col(id_col), F.col(pos).alias("_pos"))
    near = band_join(s, clusters.select(*keys, F.col(cpos).alias("partner")), keys, "_pos", "partner", width).select(id_col, "partner", F.lit("cluster").alias("source"))
    open_ = s.join(near.select(id_col).distinct(), id_col, "left_anti")
    raw = band_join(open_, ends.select(*keys, F.col(epos).alias("partner")), keys, "_pos", "partner", width).select(id_col, "partner", F.lit("ends").alias("source"))
    return near.unionByName(raw)


def windows(df: DataFrame, pos: str, size: int, one_based: bool = True) -> DataFrame:
    """Tumbling position windows: adds ``window_id``."""
    return df.withColumn("window_id", _floor_div(F.col(pos) - (1 if one_based else 0), F.lit(size).cast("bigint")))


def sliding_windows(df: DataFrame, pos: str, size: int, step: int) -> DataFrame:
    """Every sliding window [k*step, k*step+size) over a 0-based position: adds ``window_start``."""
    s, p = F.lit(step).cast("bigint"), F.col(pos).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), _floor_div(p - size, s) + 1)
    return df.withColumn("window_start", F.explode(F.transform(F.sequence(first, _floor_div(p, s)), lambda k: k * s)))
